"""The registered queries of these operators, with production parameters, and their SQL."""

from __future__ import annotations

import math

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildscope.llm import (
    decontaminate, fill_in_middle, fingerprints, jaccard_join, language_id, piece_lattice, quality, ranked_search, repeats, secret_scan,
    source_mix, token_counts, url_rules,
)
from buildscope.llm.common import sha256_of, table
from buildscope.llm.samples import remainder

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents of the folds 0, 1 and 3 of four."""
    return language_id.train(docs.filter(remainder("doc_id", 4) != 2))


def _held_out(modulus: int, fold: int):
    return F.coalesce(remainder("doc_id", modulus) == fold, F.lit(False)).alias("held_out")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_model(docs))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Neither texts nor labels of the held-out fold are learned from.
    learning = remainder("doc_id", 3) != 1
    model = quality.train(docs.filter(learning), table(spark, sf_dir, "labels").filter(learning))
    return quality.predict(docs, model).select("doc_id", _held_out(3, 1), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.join(table(spark, sf_dir, "documents"), size=4, least=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.summarize(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    made = fill_in_middle.transform(docs)
    digests = [sha256_of(F.col("output")).alias("output_sha256"), sha256_of(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), 10)


def words_taken(docs: DataFrame) -> DataFrame:
    """One row per document, in the order of training: by its first position, those that are not taken last."""
    taken = F.aggregate("taken", F.lit(0).cast("long"), lambda sum_, o: sum_ + o["words"])
    rows = source_mix.mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.try_element_at("taken", F.lit(1))["position"].alias("first_position"))
    return rows.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_repeats": op1_repeats,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_ranked_search": op12_ranked_search,
    "op13_source_mix": op13_source_mix,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

def _sql_matches(name: str, pattern: str) -> str:
    """The matches of a pattern, placed by the lengths of what lies between them."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT n, match, CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
  FROM (SELECT n, found, gaps, unnest(found) AS match, unnest(range(1, len(found) + 1)) AS i
    FROM (SELECT n, regexp_extract_all(text, '{quoted}') AS found, string_split_regex(text, '{quoted}') AS gaps FROM docs) WHERE len(found) > 0))"""


def _sql_secrets() -> str:
    with_, base = [], []
    for order, kind in enumerate(secret_scan.KINDS):
        with_.append(_sql_matches(kind.name, kind.pattern))
        quoted = kind.pattern.replace("'", "''")
        base.append(f"SELECT n, start, {order} AS ord, start + length(match) AS stop, '{kind.name}' AS kind FROM {kind.name} WHERE length(regexp_extract(match, '{quoted}', {kind.group})) >= {kind.least}")
    allowed = "|".join(secret_scan.ALLOWED)
    dense = []
    for order, d in enumerate(secret_scan.DENSE, len(secret_scan.KINDS)):
        with_.append(_sql_matches(f"{d.name}_runs", f"[{d.characters}]{{{d.least},}}"))
        with_.append(f"""{d.name}_windows AS (SELECT n, run, first, width FROM (SELECT n, start AS run, match, width, start + unnest(range(0, length(match) - width + 1)) AS first FROM (SELECT *, least(length(match), {d.window}) AS width FROM {d.name}_runs)
  WHERE NOT regexp_full_match(match, '{allowed}')) WHERE list_aggregate(string_split(substr(match, first - run + 1, width), ''), 'entropy') >= log2(width) - {math.log2(d.window) - d.bits!r} * width / {d.window} - 1e-11)""")
        dense.append(f"""SELECT n, min(first) AS start, {order} AS ord, max(first + width) AS stop, '{d.name}' AS kind FROM (SELECT *, sum(apart) OVER (PARTITION BY n, run ORDER BY first) AS part
  FROM (SELECT *, CASE WHEN first - lag(first) OVER (PARTITION BY n, run ORDER BY first) <= width THEN 0 ELSE 1 END AS apart FROM {d.name}_windows)) GROUP BY n, run, part""")
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in secret_scan.KINDS)
    zeros = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secret_scan.KINDS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
{", ".join(with_)},
base AS ({" UNION ALL ".join(base)}),
dense AS (SELECT * FROM ({" UNION ALL ".join(dense)}) d WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = d.n AND b.start <= d.start AND b.stop >= d.stop)),
counted AS (SELECT n, {counts}, sha256({joined}) AS base_sha256 FROM base GROUP BY n),
listed AS (SELECT n, {joined} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM dense) GROUP BY n)
SELECT doc_id, {zeros}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN counted USING (n) LEFT JOIN listed USING (n)"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_positions() -> str:
    """The formula of ``source_mix.position`` for the share x of each schedule."""
    turns = []
    for turn, schedule in enumerate(source_mix.SCHEDULES):
        sums = source_mix._integrals(schedule)
        whens = []
        for i, ((t0, w0), (t1, w1)) in enumerate(zip(schedule, schedule[1:])):
            rest = f"(x * {sums[-1]!r}::DOUBLE - {sums[i]!r}::DOUBLE)"
            slope = (w1 - w0) / (t1 - t0)
            t = f"least(CASE WHEN {rest} > 0 THEN {rest} * 2 / (sqrt(greatest({w0 * w0!r}::DOUBLE + {rest} * {2 * slope!r}::DOUBLE, 0::DOUBLE)) + {w0!r}::DOUBLE) ELSE 0 END + {t0!r}::DOUBLE, {t1!r}::DOUBLE)"
            whens.append(f"WHEN x * {sums[-1]!r}::DOUBLE < {sums[i + 1]!r}::DOUBLE THEN {t}" if i < len(schedule) - 2 else f"ELSE {t}")
        turns.append(f"WHEN number % {len(source_mix.SCHEDULES)} = {turn} THEN CASE {' '.join(whens)} END" if len(whens) > 1 else f"WHEN number % {len(source_mix.SCHEDULES)} = {turn} THEN {whens[0][5:]}")
    return f"CASE {' '.join(turns)} END"


SQL = {
    "op11_fill_in_middle": r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents),
drawn AS (SELECT *, len(units) AS n, CAST('0x' || digits[1:8] AS BIGINT) AS h1, CAST('0x' || digits[9:16] AS BIGINT) AS h2, CAST('0x' || digits[17:24] AS BIGINT) AS h3, CAST('0x' || digits[25:32] AS BIGINT) AS h4 FROM cut),
ranks AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM ranks)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
    "op12_ranked_search": f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWERED}, '{_TERM}') AS terms FROM documents),
docs AS (SELECT doc_id, row, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM docs),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, totals GROUP BY term, N_),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark),
scores AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * N_) // L_))))) AS BIGINT) AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (row), totals GROUP BY item_id, row),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores JOIN docs USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_source_mix": rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS th FROM documents),
copied AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size, th) - 1 AS j FROM sized),
keyed AS (SELECT *, md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || th || ':' || (j // {source_mix.BLOCK})) AS digest FROM copied),
starts AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size, th, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM keyed),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][number % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes),
remaining AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER earlier, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights_left
  FROM weighed WINDOW earlier AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, CASE WHEN words_left / weights_left * weight <= cap THEN words_left / weights_left END AS level FROM remaining),
aimed AS (SELECT source, source_size, number, coalesce(least(cap, max(level) OVER () * weight), cap) AS target FROM opened),
taken AS (SELECT doc_id, size, source_size, target, number, start, greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS taken
  FROM starts JOIN aimed ON starts.source IS NOT DISTINCT FROM aimed.source),
shares AS (SELECT *, CASE WHEN target > 0 THEN start / target END AS x FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken, CASE WHEN taken > 0 THEN {_sql_positions()} END AS first_position FROM shares""",
    "op3_secret_scan": _sql_secrets(),
    "op2_url_filter": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rest),
ranked AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
  row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM ranked WHERE place = 1""",
}
