"""Each operator on small hand-made tables: nulls, empty and long texts, repeated rows, empty tables, brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, edit_join, page_diff, queries, quotes, repetition, setsketch, sp_tokenizer, token_files, toxicity, url_words

SCHEMA = "doc_id long, text string, lang string, gone string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "on", "sh", "ble", "é"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = prose(rng, 60)
    words = base.split()
    near = " ".join([*words[:30], "x", *words[31:]])
    return [base, near, base.upper(), prose(rng, 40), "one two", "one two", "", None, " \n\t ", "a\n" * 3, prose(rng, 30_000), "Ω≈ç √∫ 𝒳 " + base]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i + 1, t, "en", "g") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[0], None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_components_equal_brute_force(docs, none, texts):
    sets = {i + 1: shingles(t, 3) for i, t in enumerate(texts)}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = setsketch.near_components(docs, 3, 85).collect()
    assert {r.id: r.component for r in got if r.id is not None} == comp
    assert {r.id: r.n for r in got if r.id is not None} == {i: len(s) for i, s in sets.items()}
    assert [r.component for r in got if r.id is None] == [None] and len(got) == len(texts) + 2
    assert setsketch.near_components(none, 3, 85).count() == 0
    kept = setsketch.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns and 1 in {r.doc_id for r in kept.collect()}


def test_sketch_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 62, 800, dtype=np.uint64), rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    both = np.concatenate([a[200:], b])
    x, y = setsketch.sketch(a), setsketch.sketch(both)
    assert (setsketch.merge(setsketch.sketch(a[:400]), setsketch.sketch(a[400:])) == x).all()
    est = setsketch.likelihood_jaccard(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([800.0]), np.array([800.0]))
    assert abs(est[0] - 0.6) < 0.15
    assert setsketch.may_reach(setsketch.parity(a), setsketch.parity(a[:-20]), np.array([800]), np.array([780]), 85).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_equals_plain_one():
    rng = random.Random(5)
    for _ in range(3000):
        a = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 2, 3, 8, 70])))
        b = bytearray(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randrange(2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2)))
        assert edit_distance(a, bytes(b)) == min(levenshtein(a, bytes(b)), 3)


edit_distance = edit_join.edit_distance


def test_line_verdicts_equal_brute_force(spark, none):
    rng = random.Random(9)
    lines = [prose(rng, 8) for _ in range(12)]
    rows = []
    for d in range(30):
        some = []
        for _ in range(4):
            line = list(rng.choice(lines))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            some.append("".join(line))
        rows.append((d, "\n".join([*some, "short"]), "en", None))
    rows += [(50, None, None, None), (51, "", None, None), (None, rows[0][1], None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = [(d, i, x.encode()) for d, t, *_ in rows if t and d is not None for i, x in enumerate(t.split("\n")) if len(x.encode()) >= 20]
    first = {}
    for d, i, x in own:
        first[x] = min(first.get(x, (d, i)), (d, i))
    near = {x: [y for y in first if y != x and levenshtein(x, y) <= 2] for x in first}
    want = {(d, i): (first[x], len(near[x]), (d, i) == first[x] and all(first[y] > first[x] for y in near[x])) for d, i, x in own}
    got = {(r.doc_id, r.line_no): ((r.class_doc_id, r.class_line_no), r.n_links, r.kept) for r in edit_join.line_verdicts(docs).collect()}
    assert got == want
    out = {r.doc_id: r.text for r in edit_join.drop_repeated_lines(docs).collect()}
    assert out[50] is None and out[51] == "" and out[0].endswith("short")
    assert edit_join.drop_repeated_lines(docs).columns == docs.columns and edit_join.drop_repeated_lines(none).count() == 0


def test_copy_with_short_lines_goes(spark):
    long = "a line that is long enough to be told apart"
    rows = [(1, f"{long}\nHaanth.\nkéé", None, None), (2, f"Haanth.\n{long}\n\nkéé", None, None), (3, f"{long}\nOnly here.\nHaanth.", None, None), (4, "Haanth.", None, None),
            (5, f"New.\n{long}", None, None), (5, f"Haanth.\n{long}", None, None), (6, long, None, None)]
    got = sorted((r.doc_id, r.text) for r in edit_join.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, rows[0][1]), (3, "Only here.\nHaanth."), (4, "Haanth."), (5, "Haanth."), (5, "New.")]
    kept = edit_join.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA), drop_empty=False).collect()
    assert len(kept) == len(rows) and {r.text for r in kept if r.doc_id == 2} == {"Haanth.\n\nkéé"}


def test_short_lines_have_exact_classes(spark, tmp_path):
    long = "a line that is long enough to be told apart"
    rows = [(1, f"Haanth.\n{long}\nHaanth.\n \n", None, None), (2, f"{long}!\n\nHaanti.\nHaanth.", None, None), (3, None, None, None), (None, "Haanth.", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op5_line_edit_join"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 1, 0, 0, True), (1, 1, 1, 1, 1, True), (1, 2, 1, 0, 0, False), (2, 0, 2, 0, 1, False), (2, 2, 2, 2, 0, True), (2, 3, 1, 0, 0, False)]


def test_large_runs_of_one_signature_lose_no_link(spark):
    head = "a common passage at the beginning of very many lines "
    rows = [(i, head + f"{i:04d}" + " and its end, the same in each", None, None) for i in range(700)]
    got = edit_join.line_verdicts(spark.createDataFrame(rows, SCHEMA)).select(F.sum("n_links")).first()[0]
    names = [f"{i:04d}".encode() for i in range(700)]
    assert got == sum(edit_distance(a, b) <= 2 for a in names for b in names if a != b)


def test_contaminated_documents(spark, none):
    rng = random.Random(11)
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (3, None), (4, ""), (5, "three word item")]
    it = spark.createDataFrame(items, "item_id long, text string")
    inside = prose(rng, 50) + "\n" + items[0][1].upper() + " " + prose(rng, 20)
    changed = items[0][1].split()
    changed[-1] = "other"
    rows = [(1, inside, "", ""), (2, prose(rng, 80), "", ""), (3, " ".join(changed), "", ""), (4, None, "", ""), (5, "", "", ""), (6, items[1][1], "", ""), (6, items[1][1], "", ""),
            (None, inside, "", ""), (7, "so three word item here", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.item_id): r.best_shared for r in decontaminate.contaminated(docs, it).collect()}
    assert got == {(1, 1): 26, (3, 1): 25, (6, 2): 8, (7, 5): 1}
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(docs, it).collect()) == [0, 2, 4, 5]
    assert decontaminate.contaminated(none, it).count() == 0 and decontaminate.contaminated(docs, it.where("false")).count() == 0


def similar_starts(doc, item):
    def weights(ws):
        return Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))

    doc, item = doc.split(), item.split()
    want = []
    for s in range(max(len(doc) - len(item), 0) + 1):
        a, b = weights(doc[s:s + len(item)]), weights(item)
        if 100 * sum((a & b).values()) >= 80 * sum((a | b).values()):
            want.append(s)
    return want


def test_reordered_passages_are_found_at_every_start(spark):
    rng = random.Random(12)
    rows, items = [], []
    for i in range(8):
        ws = [f"w{i}x{j}" for j in range(50)]
        cut = 25 if i < 4 else rng.randrange(8, 42)
        noise = [f"n{i}x{j}" for j in range(60)]
        items.append((i, " ".join(ws)))
        rows.append((i, " ".join([*noise[:7 * i], *ws[cut:], *ws[:cut], *noise[7 * i:]]), "", ""))
    rows += [(20, items[0][1] + " end", "", ""), (21, " ".join(items[0][1].split()[:47]), "", ""), (22, items[1][1] + " " + items[1][1], "", "")]
    got = {(r.doc_id, r.item_id): r.windows for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): len(similar_starts(t, x)) for d, t, *_ in rows for i, x in items}
    assert all(want[i, i] for i in range(8)) and got == {k: n for k, n in want.items() if n}


def test_items_with_repeated_shingles_are_found(spark):
    items = [(i, " ".join([*(f"w{i}x{j}" for j in range(45)), *["0"] * 9])) for i in range(40)]
    rows = [(i, " ".join([*(f"w{i}x{j}" for j in range(45)), *["0"] * 4, *(f"n{i}x{j}" for j in range(5))]), "", "") for i in range(40)]
    assert all(similar_starts(t, items[i][1]) == [0] for i, t, *_ in rows)
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.best_shared) for r in got) == [(i, i, 45) for i in range(40)]


def test_sentencepiece_parity_and_round_trip(docs, none, texts):
    import sentencepiece

    path = queries.tokenizer(queries.SP_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sp_tokenizer.decode(sp_tokenizer.encode(docs, path), path).collect()
    for r in rows:
        assert r.ids == sp.encode(r.text or "") and r.parity and r.decoded == (r.text or "") and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sp_tokenizer.encode(none, path).count() == 0


def test_unigram_model_is_rebuilt():
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -4.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    model = sp_tokenizer.SpModel.parse(data)
    assert model.model_type == 1 and [p[0] for p in model.pieces] == [p[0] for p in pieces] and not model.squeeze
    assert sp_tokenizer.build(data).encode("ab a").tokens == ["▁ab", "▁a"]


def test_token_files_equal_whole_encoding(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer(queries.WORD_BPE)
    tok, at = Tokenizer.from_file(path), 0
    got = token_files.round_trip(docs, path, 2).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for g, r in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(none, path, 2).count() == 0


def test_toxicity_learns_and_scores_everything(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) + (" vile scum" * 3 if i % 6 == 0 else ""), None, None) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    out = toxicity.scored(table, model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 6 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, model).collect())
    assert toxicity.scored(none, model).count() == 0 and toxicity.scored(docs, toxicity.train(docs, labels.where("false"))).where("score < 0.5").count() == docs.count()


def test_repetition_equals_brute_force(texts):
    rng = random.Random(4)
    cases = [*texts, *["\n".join(rng.choice(["a b c d e f", "g h", " ", "é x # y"]) for _ in range(12)) for _ in range(30)]]
    got = repetition.measure(pa.array(cases))
    for n, t in enumerate(cases):
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        assert got["n_words"][n] == len(w) and got["word_chars"][n] == sum(map(len, w))
        for k in repetition.MOST:
            grams = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
            seen = {g for g in grams if grams.count(g) > 1} if len(w) < 500 else set()
            cover = {i + o for i, g in enumerate(grams) if g in seen for o in range(k)}
            if len(w) < 500:
                assert got[f"chars_{k}"][n] == sum(len(w[i]) for i in cover)
                if k == 5:
                    assert got["n_repeat_words"][n] == len(cover)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t")]
        assert got["n_dup_lines"][n] == len(lines) - len(set(lines))


def test_url_rules_and_words(spark):
    urls = ["https://a.NET/x", "http://www.example.net/en/1", "http://example.net/de/1", "http://x.org/fr/2", "http://x.org/cheap-pills", "http://x.org/cheapest", "http://y.de/?q=porn",
            None, "no scheme", "http://example.com/de/", "x://h?porno", ""]
    got = [tuple(r)[1:] for r in url_words.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [g[2:4] for g in got] == [("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "block"), (None, "allow"), (None, "block"),
                                     (None, "allow"), (None, "allow"), ("example.com/de/", "block"), (None, "allow"), (None, "allow")]
    assert got[0][:2] == ("a.net", "/x") and got[7][:2] == ("", "") and got[8][:2] == ("", "") and got[10][:2] == ("h", "")


def test_page_differencing(spark, none):
    def page(body):
        return f"<html><head><title>t</title></head><body>{body}</body></html>"

    site = "<div>Our site name</div><p>All rights reserved</p>"
    rows = [(1, "http://h/a/1", page(f"{site}<p>First &amp; only\n text.</p>")), (2, "http://h/a/2", page(f"{site}<p>Second<br>text.</p>")),
            (3, "http://g/1", page("<nav>menu</nav><article><h1>Head</h1><p>Body &lt;x&gt;.<p>Share this<aside>side</aside></article><div class='comments'><p>Me too</div>")),
            (4, "http://g/2", page("<article><h1>Other</h1><p>Body &lt;x&gt;.<p>Share this</article><footer>f</footer>")), (5, None, None), (6, "http://alone/", "<p>x"), (6, "http://alone/", "<p>x")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in page_diff.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [g[:2] for g in got] == [(1, "First & only text."), (2, "Second text."), (3, "Head\n\nBody <x>."), (4, "Other\n\nBody <x>."), (5, ""), (6, "x"), (6, "x")]
    assert all(n == len(t) for _, t, n in got)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(page_diff.common(a, b)) == best[-1][-1]


def lines_text(page):
    found = page_diff.blocks(page)
    return page_diff.text_of([b[0] for b in found], [b[1] for b in found], None)


@pytest.mark.parametrize("page,want", [
    ("<article><p class=it's>Hello <b>x</b> world</p><p>That's it. More text.</p><p>Last</p></article>", "Hello x world\n\nThat's it. More text.\n\nLast"),
    ("<article><div class='share-price'>Price 5</div><p>a <label>b</label></p><div class='share-buttons'>Tweet</div></article>", "Price 5\n\na b"),
    ("<p title=\"a > b\">x</p><p title='it is'>y</p><a href=unclosed\">z</a>", "x\n\ny\n\nz"),
    ("a < b <1 <!-- <p>no</p> --> c<script>if (a<b) '</p>'</SCRIPT>d <br> e", "a < b <1 c d e".replace("c d", "cd")),
    ("<nav>n</nav><p>t<aside>s</aside>u<form>f</form></p><div class='site-footer'>z</div><div id=comments>c</div>", "t\n\nu"),
    ("", ""), (None, ""), ("<p>open", "open"), ("<", "<"), ("<p", "<p")])
def test_blocks(page, want):
    assert lines_text(page) == want


@pytest.mark.parametrize("bad", ['<a "', '<a ="', "<a x='", "<!--", "<script>", "<p>x", "<div class=a>", "<", "&", '<a =">" ', "</", "<svg/>"])
def test_broken_markup_takes_linear_time(bad):
    import time

    def took(n):
        t0 = time.process_time()
        page_diff.blocks(bad * (n // len(bad)))
        return time.process_time() - t0

    assert took(800_000) < 40 * max(took(100_000), 0.02)


def test_alignment_of_many_equal_lines():
    import time

    t0 = time.process_time()
    a, b = [i % 2 for i in range(6000)], [i * i % 3 % 2 for i in range(6000)]
    got = page_diff.common(a, b)
    assert time.process_time() - t0 < 5 and got == sorted(set(got))
    at = iter(b)
    assert all(any(a[i] == x for x in at) for i in got)


def diffed(pages):
    """Brute force: every page against its nearest pages of other lines on the host."""
    out = {}
    for host in {h for h, _, _ in pages}:
        own = sorted((p, i) for i, (h, p, _) in enumerate(pages) if h == host)
        lists, order = {}, []
        for p, i in own:
            found = tuple(page_diff.blocks(pages[i][2]))
            if found not in lists:
                lists[found] = len(order)
                order.append(found)
        for _, i in own:
            found = tuple(page_diff.blocks(pages[i][2]))
            at, last = lists[found], len(order) - 1
            near = [1, 2] if at == 0 else [at - 1, at - 2] if at == last else [at - 1, at + 1]
            others = [[x[0] for x in order[k]] for k in near if 0 <= k <= last and k != at]
            keys, bits = [x[0] for x in found], [x[1] for x in found]
            control = [len(x.split()) <= 8 and x[-1:] not in ".!?…:;,)]\"'»”" for x in keys]
            gone = page_diff.shared_lines(keys, bits, [len(x) for x in keys], control, others)
            out[i] = page_diff.text_of(keys, bits, gone)
    return out


def test_page_differencing_equals_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for n in range(60):
        host, marked = rng.choice("abc"), rng.random() < 0.4
        site = f"<div>{host} site</div><p>Legal notice of {host}. All rights.</p>"
        body = "".join(f"<p>{rng.choice(['Share this', 'A sentence that many have.', f'Own {n} {k} text.', f'Own {n} {k} text.'])}</p>" for k in range(rng.randrange(1, 7)))
        pages.append((host, f"/{rng.randrange(20)}/{n}", f"{site}<article><h1>H{n % 3}</h1>{body}</article>" if marked else site + body))
    for copy in (3, 3, 4):
        pages.append((pages[copy][0], pages[copy][1] + "z", pages[copy][2]))
    near = "<div>d site</div>" + "".join(f"<p>Long shared sentence number {k} of the copies.</p>" for k in range(9))
    pages += [("d", f"/{i}", near + f"<p>Edition {i}.</p>") for i in range(4)]  # near copies of each other keep their text
    table = spark.createDataFrame([(i, f"http://{h}{p}", page) for i, (h, p, page) in enumerate(pages)], "page_id long, url string, html string").withColumn("lines", F.lit(1)).repartition(5)
    got = {r.page_id: r for r in page_diff.extracted(table).collect()}
    want = diffed(pages)
    assert {i: got[i].text for i in got} == want
    assert sum(r.n_gone for r in got.values()) > 60 and "Long shared sentence number 4" in got[len(pages) - 1].text
    assert all("site" not in want[i] for i, (h, _, page) in enumerate(pages) if h in "abc" and "<article>" in page)


def test_page_differencing_of_empty_tables_and_long_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_diff.extracted(empty).collect() == []
    rows = [(1, "http://h/1", "<p>" + "word " * 200_000), (2, "http://h/1", "<p>same path"), (3, "http://h/1", "<p>same path"), (None, "http://h/2", "<p>x"), (4, "no host", "<p>y")]
    got = sorted((r.page_id or 0, r.n_chars) for r in page_diff.extracted(spark.createDataFrame(rows, empty.schema)).collect())
    assert got == [(0, 1), (1, 999_999), (2, 9), (3, 9), (4, 1)]


def test_large_conversation_is_cut_into_ranges(spark):
    rnd = random.Random(5)
    rows = [("big" if rnd.random() < 0.8 else f"c{i % 5}", i) for i in range(500)]
    quoted = {(c, t): rnd.choice([u for d, u in rows if d == c and u < t] or [None]) for c, t in rows if t % 13 == 0}
    quoted = {k: p for k, p in quoted.items() if p is not None}
    turns = spark.createDataFrame(rows, "conv_id string, turn long")
    parents = spark.createDataFrame([(*k, p) for k, p in quoted.items()], "conv_id string, turn long, quoted_parent long")
    want, last = set(), {}
    for c, t in sorted(rows):
        before, branch = last.get(c, (None, None))
        parent = quoted.get((c, t), before)
        branch = t if before is None or parent != before else branch
        last[c] = (t, branch)
        want.add((c, t, parent, branch))
    got = quotes.chained(turns, parents).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_quotation_links(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday, U wrote:\n> How are you?\nFine."), (1, 2, "user", "x"), (1, 3, "user", ">> how are  YOU?\n> fine.\nGood"),
            (1, 4, "assistant", "> Hello there\nhi"), (1, 5, "user", "ok"), (2, 0, "user", None), (None, 0, "user", "a"), (3, None, "user", "a"), (1, 5, "user", "ok")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quoted, r.n_linked, r.depth_quoted, r.branch, r.content) for r in quotes.linked(table).collect()}
    assert got == {(1, 0): (None, 0, 0, 0, 0, "Hello there\nHow are you?"), (1, 1): (0, 1, 1, 1, 0, "Fine."), (1, 2): (1, 0, 0, 0, 0, "x"), (1, 3): (1, 2, 2, 2, 3, "Good"),
                   (1, 4): (0, 1, 1, 1, 4, "hi"), (1, 5): (4, 0, 0, 0, 4, "ok"), (2, 0): (None, 0, 0, 0, 0, "")}
    whole = {r.conv_id: [m.turn for m in r.messages] for r in quotes.conversations(table).collect()}
    assert whole == {1: [0, 1, 2, 3, 4, 5], 2: [0]}
    assert quotes.linked(table.where("false")).count() == 0


def test_rewrapped_and_partial_quotations(spark):
    first = "The meeting is on Monday at noon. Please bring the figures of the last quarter, all of them.\nThanks a lot for that"
    rows = [(1, 0, first), (1, 1, "Something else entirely. With two sentences here."), (1, 2, "> The meeting is on Monday\n> at noon. Please bring the figures of\n> the last quarter, all of them.\nFine."),
            (1, 3, "> Please bring the figures of the last quarter, all of them.\nWhich?"), (1, 4, "> With two sentences here.\nYes"), (1, 5, "> Nobody said this before, ever.\nHm"), (1, 6, "> all of them.\nshort"),
            (1, 7, ">> Something else entirely.\n>> With two\n>> sentences here.\n> Yes\nok"), (2, 0, "> The meeting is on Monday at noon."), (2, 1, "x" * 200_000 + ". And more of it.")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "conv_id long, turn long, text string, words string, place int")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quoted, r.n_linked) for r in quotes.linked(table).collect()}
    assert got == {(1, 0): (None, 0, 0), (1, 1): (0, 0, 0), (1, 2): (0, 3, 3), (1, 3): (0, 1, 1), (1, 4): (1, 1, 1), (1, 5): (4, 1, 0), (1, 6): (5, 1, 0), (1, 7): (4, 4, 4), (2, 0): (None, 1, 0), (2, 1): (0, 0, 0)}


def test_planted_quotations_are_found(spark):
    """Messages that quote one to three sentences of an earlier one, wrapped anew: all lead back to it."""
    rng = random.Random(11)
    rows, want = [], {}
    for conv in range(4):
        said = []
        for turn in range(25):
            own = [f"{prose(rng, rng.randrange(3, 14))} c{conv}t{turn}s{k}." for k in range(rng.randrange(2, 6))]
            lines = []
            if said and rng.random() < 0.7:
                parent = rng.randrange(len(said))
                at = rng.randrange(len(said[parent]))
                words = " ".join(said[parent][at:at + rng.randrange(1, 4)]).split()
                while words:
                    n = rng.randrange(2, 9)
                    lines.append("> " + " ".join(words[:n]))
                    words = words[n:]
                want[conv, turn] = parent
            rows.append((conv, turn, "\n".join([*lines, " ".join(own)])))
            said.append(own)
    got = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)).collect()}
    assert {k: got[k].parent_turn for k in want} == want
    assert all(got[k].n_linked == got[k].n_quoted > 0 for k in want)
