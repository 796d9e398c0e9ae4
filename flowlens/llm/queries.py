"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import decontaminate, edit_join, merkle, packing, page_diff, phrases, quotes, repetition, setsketch, sp_tokenizer, token_files, toxicity, url_words
from flowlens.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD = "'[^\\x20\\x09-\\x0D]+'"

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.y) AS component_id, min(r.y) = n.doc_id AS kept
FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op6_setsketch_near_dedup", OP6_SQL)
def op6(spark, sf_dir):
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85."""
    out = setsketch.near_components(table(spark, sf_dir, "documents"), k=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


OP5_SQL = f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM t),
u AS (SELECT * FROM l WHERE regexp_matches(line, {WORD})),
c AS (SELECT line, strlen(line) AS n, min({{'d': doc_id, 'l': line_no}}) AS at FROM u GROUP BY 1),
e AS (SELECT * FROM c WHERE n >= {edit_join.MIN_BYTES}),
k AS (SELECT a.line, b.at AS other FROM e a JOIN e b ON b.n IN (a.n - 2, a.n - 1, a.n, a.n + 1, a.n + 2) AND a.line <> b.line
      AND levenshtein(a.line, b.line) <= 2),
g AS (SELECT line, count(*) AS n_links, min(other) AS earliest FROM k GROUP BY 1)
SELECT u.doc_id, CAST(u.line_no AS INTEGER) AS line_no, c.at.d AS class_doc_id, CAST(c.at.l AS INTEGER) AS class_line_no,
       coalesce(g.n_links, 0) AS n_links, (u.doc_id = c.at.d AND u.line_no = c.at.l AND (g.earliest IS NULL OR g.earliest > c.at)) AS kept
FROM u JOIN c USING (line) LEFT JOIN g USING (line)
"""


@query("op5_line_edit_join", OP5_SQL)
def op5(spark, sf_dir):
    """Every line with a word of all documents: the first place of its text, links to other texts within two edits, and whether it stays."""
    return edit_join.line_verdicts(table(spark, sf_dir, "documents"), short=True).drop("h1", "h2")


OP10_SQL = f"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(text), {WORD}) AS ws FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD}) AS ws FROM documents),
ig AS (SELECT item_id, len(ws) AS w, unnest(range(len(ws) - 4)) AS o, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) AS g FROM it),
dg AS (SELECT doc_id, len(ws) AS n, unnest(range(len(ws) - 4)) AS p, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) AS g FROM d WHERE len(ws) >= 5),
win AS (SELECT DISTINCT doc_id, item_id, w, n, unnest(range(greatest(0, p - w + 5), greatest(0, least(p, n - w)) + 1)) AS s FROM dg JOIN ig USING (g)),
wg AS (SELECT win.doc_id, item_id, s, dg.g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.p BETWEEN s AND s + w - 5 GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL),
sh AS (SELECT wg.doc_id, wg.item_id, s, CAST(sum(wg.c) AS BIGINT) AS nw, CAST(sum(least(wg.c, coalesce(ic.c, 0))) AS BIGINT) AS k FROM wg LEFT JOIN ic ON ic.item_id = wg.item_id AND ic.g = wg.g GROUP BY ALL),
ni AS (SELECT item_id, CAST(sum(c) AS BIGINT) AS ni FROM ic GROUP BY 1)
SELECT doc_id, item_id, count(*) AS windows, max({{'k': k, 'nw': nw}}).k AS best_shared, max({{'k': k, 'nw': nw}}).nw AS window_shingles, any_value(ni) AS item_shingles
FROM sh JOIN ni USING (item_id) WHERE 100 * k >= 80 * (nw + ni - k) GROUP BY doc_id, item_id
"""


@query("op10_simhash_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    """Documents and benchmark items with a similar window, over all documents and items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SP_MODEL = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    """Ids of every document by the rebuilt SentencePiece tokenizer, with parity against the original library."""
    return sp_tokenizer.digests(table(spark, sf_dir, "documents"), tokenizer(SP_MODEL))


@query("op8_nnpu_toxicity")
def op8(spark, sf_dir):
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_token_files")
def op9(spark, sf_dir):
    """Start, length and checksum of every document in the token files."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), END_ID)


def _op2_sql() -> str:
    lengths = list(repetition.MOST)
    grams = "\n".join(f""", g{k} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {k - 1}], ' ')) > 1 AS r FROM p WHERE i <= len(ws) - {k - 1}),
c{k} AS (SELECT DISTINCT doc_id, i + o AS i FROM g{k}, range({k}) t(o) WHERE r),
s{k} AS (SELECT p.doc_id, count(*) AS n, CAST(sum(length(ws[p.i])) AS BIGINT) AS chars FROM p JOIN c{k} USING (doc_id, i) GROUP BY 1)""" for k in lengths)
    joins = "\n".join(f"LEFT JOIN s{k} USING (doc_id)" for k in lengths)
    cols = ", ".join(f"coalesce(s{k}.chars, 0) AS chars_{k}" for k in lengths)
    high = " OR ".join([*(f"100 * chars_{k} > {round(100 * m)} * word_chars" for k, m in repetition.MOST.items()), f"100 * chars_lines > {round(100 * repetition.MOST_LINES)} * word_chars"])
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {WORD}), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, line, count(*) AS n, len(array_to_string(regexp_extract_all(line, {WORD}), '')) AS chars FROM l WHERE regexp_matches(line, {WORD}) GROUP BY 1, 2),
ls AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS dup, CAST(sum(CASE WHEN n > 1 THEN n * chars ELSE 0 END) AS BIGINT) AS chars FROM lc GROUP BY 1)
{grams},
a AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ls.dup, 0) AS n_dup_lines, coalesce(s5.n, 0) AS n_repeat_words,
 {cols}, coalesce(ls.chars, 0) AS chars_lines FROM d LEFT JOIN ls USING (doc_id) {joins})
SELECT *, {failed} AS base_failed, NOT {failed} AND NOT ({high}) AS kept FROM a
"""


@query("op2_repetition_coverage", _op2_sql())
def op2(spark, sf_dir):
    """Repetition coverage of every document."""
    return repetition.coverage(table(spark, sf_dir, "documents"))


def _op4_sql() -> str:
    def count(terms, distinct):
        bound = "CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" if distinct else "len(regexp_extract_all(regexp_replace(u, '[^a-z0-9]', '  ', 'g'), '(^| ){t}( |$)'))"
        return " + ".join(bound.replace("{t}", t) for t in terms)

    rules = sorted(url_words.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + f" WHEN strict_hits > 0 OR soft_terms >= {url_words.SOFT_HITS} THEN 'block' ELSE 'allow' END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (SELECT page_id, coalesce({lower.format('url')}, '') AS u, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
b AS (SELECT page_id, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1, 's')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path,
 CAST({count(url_words.STRICT, False)} AS BIGINT) AS strict_hits, CAST({count(url_words.SOFT, True)} AS BIGINT) AS soft_terms FROM a)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, strict_hits, soft_terms FROM b
"""


@query("op4_url_vocabulary", _op4_sql())
def op4(spark, sf_dir):
    """Verdict on every page's URL."""
    return url_words.judged(table(spark, sf_dir, "pages"))


@query("op1_quotation_links")
def op1(spark, sf_dir):
    """Every message of all conversations with its parent, its place in reply order and its text without quotations."""
    return quotes.linked(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "parent_turn", "n_quoted", "n_linked", "depth_quoted", "branch", "order_key",
                                                                       F.length("content").cast("long").alias("n_chars"), F.crc32(F.col("content").cast("binary")).alias("content_crc32"))


@query("op3_page_differencing")
def op3(spark, sf_dir):
    """Main text of every page."""
    return page_diff.extracted(table(spark, sf_dir, "pages"))


@query("op11_bestfit_packing")
def op11(spark, sf_dir):
    """Sequence and offset of every piece of all documents."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), 2048, 0, with_ids=False)


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEVELS = 6  # of the SQL: 16 ** 6 rows of a source at most


def _op12_sql() -> str:
    def fields(text):
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"

    bits = "list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: (ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"
    steps = [f"""l AS (SELECT doc_id, source, {fields('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {fields(LOWER.format('text'))} ELSE {fields('text')} END AS x FROM documents)""",
             "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, '' AS proof FROM l)",
             "t0 AS (SELECT source AS g, r, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM a0)"]

    def climb(t, a, key, levels):
        for k in range(levels):
            run = "PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN"
            steps.append(f"{t}{k}s AS (SELECT g, r, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {t}{k})")
            steps.append(f"{t}{k + 1} AS (SELECT g, r // 16 AS r, (max(n) + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h FROM {t}{k} GROUP BY g, r // 16)")
            steps.append(f"{a}{k + 1} AS (SELECT {a}{k}.* REPLACE ({a}{k}.r // 16 AS r, proof || lft || rgt AS proof, CASE WHEN s.n > 1 THEN sha256(lft || x || rgt) ELSE x END AS x) FROM {a}{k} JOIN {t}{k}s s ON s.g IS NOT DISTINCT FROM {key} AND s.r = {a}{k}.r)")

    climb("t", "a", "source", LEVELS)
    steps.append(f"u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, count(*) OVER () AS n, h, g AS name FROM t{LEVELS})")
    steps.append(f"b0 AS (SELECT doc_id, leaf, x, proof, u0.r, u0.h AS subroot FROM a{LEVELS} JOIN u0 ON u0.name IS NOT DISTINCT FROM source)")
    climb("u", "b", "0", 3)
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, u3.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = u3.h AS verified FROM b3, u3"


@query("op12_merkle_manifest", _op12_sql())
def op12(spark, sf_dir):
    """Leaf, roots and checked proof of every document, with the text of every fifth put into lower case."""
    docs = table(spark, sf_dir, "documents")

    def leaf(text):
        return merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lower)).alias("tampered"))
    out = merkle.manifest(rows, "source", ["doc_id"], "leaf", carry=["doc_id", "tampered"])
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p.left, p.right)), "")
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op13_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS phrase FROM ws" for k in range(1, phrases.LONGEST + 1))
    return f"""
WITH ps AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM ps),
c AS (SELECT lang, k, phrase, count(*) AS n FROM ({grams}) GROUP BY ALL),
words AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, n, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND n >= {phrases.LEAST}),
subs AS (SELECT lang, n, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase FROM cand),
own AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM subs WHERE subs.lang = cand.lang AND subs.phrase = cand.phrase AND 100 * subs.n >= {phrases.SUBSUMED} * cand.n)),
cuts AS (SELECT lang, phrase, n AS a, w, k, unnest(range(1, k)) AS cut FROM own),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, l.n AS l, r.n AS r, CAST({phrases.SCALE}::HUGEINT * a // (l.n + r.n) AS BIGINT) AS score
      FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN c r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
m AS (SELECT lang, phrase, a, arg_min(l, score * 10 + cut) AS l, arg_min(r, score * 10 + cut) AS r, min(score) AS score FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN words USING (lang) WHERE rank <= {phrases.TOP}
"""


@query("op13_phrase_collocations", _op13_sql())
def op13(spark, sf_dir):
    """The best-scoring phrases of each language of all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
