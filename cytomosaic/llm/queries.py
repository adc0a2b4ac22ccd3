"""The registered queries of the text operators; ``register`` adds them, and ``ORACLES`` has their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic.llm import chaining, curriculum, infill, langid, nearcopies, pieces, quality, secrets, suffixes, templates, urls, warc, whitening
from cytomosaic.llm.common import Workspace, table

Query = Callable[[SparkSession, str], DataFrame]
ORACLES: dict[str, str] = {}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def model_bytes(name: str) -> bytes:
    """A public tokenizer's file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read back and assembled."""
    ws = Workspace(spark, "warc")
    folder = ws.folder("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = ws.keep(warc.read_archives(spark, folder, payloads=False), "records")
    return warc.payload_table(warc.assemble(records), ws)


def op2_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with passages of 50 words or more that another document has, exactly or nearly."""
    found = chaining.repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id", "n_words", F.size("spans").cast("long").alias("n_passages"), "n_covered", F.array_join(spans, ",").alias("spans"), "partner", "n_partners"
    )


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose remainder is not 0; a null doc_id has no remainder and counts as held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.train(docs.filter(~F.col("held_out")))
    labelled = langid.label(docs.select("doc_id", "held_out", "text"), model)
    return labelled.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


# fixed rules of the query: (verdict, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op5_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page, by its own rule or that of the pages it is linked with."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are documents labelled as good and not toxic, distrusted those labelled as bad; toxic ones that read well are neither."""
    trusted = F.when(F.col("quality") == 0, False).when(F.col("toxic") == 0, True)
    labels = table(spark, sf_dir, "labels").select("doc_id", trusted.alias("trusted"))
    return quality.judge(table(spark, sf_dir, "documents"), labels)


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are ``kind:start:end`` of whole matches; a repository is a document, copies counted once, and its owner is the source."""
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"], owner="source")
    return secrets.digest(found)


def op9_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op8_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter("doc_id IS NOT NULL").withColumnRenamed("item", "item_id")


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), k=3, percent=85, rows=8)


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in training order, with what the mix takes of each; ``first_position`` counts the words before its first visit."""
    mixed = curriculum.in_order(curriculum.curriculum(table(spark, sf_dir, "documents")))
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda done, v: done + v["words"])
    first = F.floor(F.get("visits", F.lit(0))["position"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("visits").alias("n_visits"), first.alias("first_position"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the cut texts, and of the texts put together again from them."""
    out = infill.infill(table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(text).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spelling(url: str) -> str:
    """``urls.usual_spelling`` in DuckDB's SQL."""
    host = f"regexp_replace({_host(url)}, '^(www|m)\\.', '')"
    path = f"regexp_replace({_path(url)}, '(?s)(/index)?(\\.html?|/)+$', '')"
    query = f"string_split(regexp_extract({url}, '(?s)\\?([^#]*)', 1), '&')"
    tail = f"array_to_string(list_sort(list_filter({query}, lambda p: NOT regexp_matches(p, '{urls.CAMPAIGN}') AND p <> '')), '&')"
    return f"CASE WHEN {_host(url)} <> '' THEN {host} || {path} || CASE WHEN {tail} <> '' THEN '?' || {tail} ELSE '' END END"


def _host(url: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{letters}', '{letters.lower()}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _rule(what: int) -> str:
    cases = [
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{(kind, host + path)[what]}'"
        for kind, host, path in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    ]
    return f"CASE {' '.join(cases)} END"


def _stated(tag: str, address: str) -> str:
    return f"replace(nullif(regexp_extract(regexp_extract(coalesce(html, ''), {_quoted(tag)}), {_quoted(address)}, 1), ''), '&amp;', '&')"


def _without_dots(path: str) -> str:
    """``urls.without_dots``: segments behind the root, each put on or taken off."""
    parts = f"string_split(regexp_replace({path}, '(^|/)(\\.\\.?)$', '\\1\\2/'), '/')[2:]"
    return f"list_reduce({parts}, lambda done, part: CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END, '')"


def _resolved(link: str, url: str) -> str:
    """``urls.resolved`` in DuckDB's SQL."""
    own, rest = f"regexp_extract({link}, '(?s)^([^?#]*)', 1)", f"regexp_extract({link}, '(?s)^[^?#]*(.*)$', 1)"
    root = f"regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)"
    folder = f"'/' || regexp_extract({_path(url)}, '(?s)^/(.*/)?', 1)"
    return (
        f"CASE WHEN {link} IS NULL THEN NULL WHEN contains({own}, '://') THEN {link} WHEN starts_with({link}, '//') THEN 'http:' || {link} "
        f"WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {root} = '' OR {url} IS NULL THEN NULL "
        f"WHEN starts_with({own}, '/') THEN {root} || {_without_dots(own)} || {rest} WHEN {own} <> '' THEN {root} || {_without_dots(f'{folder} || {own}')} || {rest} "
        f"WHEN starts_with({rest}, '?') THEN {root} || {_path(url)} || {rest} ELSE {root} || {_path(url)} || regexp_extract({url}, '(?s)(\\?[^#]*)', 1) END"
    )


ORACLES["op5_url_equivalence"] = f"""
WITH RECURSIVE s AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, url, {_stated(urls.BASE, urls.HREF)} AS base_link, {_stated(urls.CANONICAL, urls.HREF)} AS canonical_link,
         {_stated(urls.REFRESH, urls.TARGET)} AS refresh_link FROM pages),
b AS MATERIALIZED (SELECT *, coalesce({_resolved("base_link", "url")}, url) AS against FROM s),
l AS MATERIALIZED (SELECT *, {_resolved("canonical_link", "against")} AS canonical, {_resolved("refresh_link", "against")} AS refresh FROM b),
p AS MATERIALIZED (SELECT r, page_id, {_host("url")} AS host, {_path("url")} AS path, {_spelling("url")} AS spelling, canonical, refresh FROM l),
q AS MATERIALIZED (SELECT *, {_rule(1)} AS rule, {_rule(0)} AS own, {_spelling("canonical")} AS c, {_spelling("refresh")} AS f FROM p),
e AS (SELECT spelling AS a, c AS b FROM q UNION SELECT spelling, f FROM q),
links AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS spelling, min(b) AS label FROM reach GROUP BY a),
placed AS (SELECT q.*, coalesce(label, q.spelling) AS class FROM q LEFT JOIN classes USING (spelling)),
said AS (SELECT class, bool_or(own = 'allow') AS allows FROM placed WHERE class IS NOT NULL AND own IS NOT NULL GROUP BY class)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allows THEN 'allow' WHEN NOT allows THEN 'block' ELSE 'allow' END) AS verdict
FROM placed LEFT JOIN said USING (class)"""


def _time(demand: str, schedule: list[tuple[float, float]]) -> str:
    """``curriculum.time_of`` in DuckDB's SQL."""
    out = "NULL"
    for begin, length, weight, slope, done in curriculum.segments(schedule):
        rest = f"({demand} - {done!r}::DOUBLE)"
        root = f"sqrt(greatest({weight * weight!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * {rest}, 0::DOUBLE))"
        inside = f"CASE WHEN {rest} <= 0 THEN 0 ELSE least(2::DOUBLE * {rest} / ({weight!r}::DOUBLE + {root}), {length!r}::DOUBLE) END"
        out = f"CASE WHEN {rest} >= 0 OR {begin!r} = 0 THEN {begin!r}::DOUBLE + {inside} ELSE {out} END"
    return out


def _by_source(values: list[str]) -> str:
    return f"CASE cycle {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END"


_MOST = curriculum.MOST_VISITS
ORACLES["op11_curriculum_mix"] = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS s, len(regexp_extract_all(coalesce(text, ''), '{curriculum.WORD}')) AS size,
         md5('{curriculum.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY s) - 1) % {len(curriculum.CYCLE)} AS cycle FROM d GROUP BY s),
w AS MATERIALIZED (SELECT *, {_by_source([f"{curriculum.integral(c)!r}::DOUBLE" for c in curriculum.CYCLE])} AS weight FROM src),
level AS (
  SELECT 0::BIGINT AS n, (SELECT sum(source_size) FROM w)::DOUBLE AS words, (SELECT sum(weight) FROM w) AS free
  UNION ALL
  SELECT m.n, (SELECT sum(source_size) FROM w)::DOUBLE - held, rest FROM (
    SELECT level.n AS before, count(*) FILTER (weight * words / free > {_MOST} * source_size) AS n,
           sum(CASE WHEN weight * words / free > {_MOST} * source_size THEN {_MOST} * source_size ELSE 0 END)::DOUBLE AS held,
           sum(CASE WHEN weight * words / free > {_MOST} * source_size THEN 0 ELSE weight END) AS rest
    FROM level, w GROUP BY level.n) m WHERE m.n > m.before),
last AS (SELECT words, free FROM level ORDER BY n DESC LIMIT 1),
t AS (SELECT w.*, CASE WHEN weight * words / free > {_MOST} * source_size THEN ({_MOST} * source_size)::DOUBLE ELSE weight * words / free END AS target FROM w, last),
placed AS (
  SELECT doc_id, size, source_size, target, weight, cycle,
         coalesce(sum(size) OVER (PARTITION BY s ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d JOIN t USING (s)),
seen AS (
  SELECT *, [greatest(least(floor(target)::BIGINT - k * source_size - a, size), 0) FOR k IN range({_MOST})] AS words,
         CASE WHEN target > 0 THEN weight * a::DOUBLE / target END AS demand FROM placed)
SELECT doc_id, size, source_size, target, list_sum(words)::BIGINT AS taken, len(list_filter(words, lambda x: x > 0))::INT AS n_visits,
       CASE WHEN words[1] > 0 THEN floor(({_by_source([_time("demand", c) for c in curriculum.CYCLE])}) * (SELECT sum(source_size) FROM w)::DOUBLE)::BIGINT END AS first_position
FROM seen"""

_MARKED = " OR ".join(f"contains(text, '{m}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
_DRAWS = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
ORACLES["op12_infill"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{infill.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {_DRAWS} FROM d),
f AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
         CASE WHEN text = '' OR {_MARKED} OR h3 % 100 >= {100 - infill.PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM f),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{infill.PREFIX}' || pre || '{infill.SUFFIX}' || suf || '{infill.MIDDLE}' || mid
                 ELSE '{infill.SUFFIX}' || suf || '{infill.PREFIX}' || pre || '{infill.MIDDLE}' || mid END AS out FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(out) AS output_sha256, sha256(text) AS restored_sha256
FROM o"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_captures,
        op2_collinear_passages,
        op3_language_spans,
        op4_suffix_dedup,
        op5_url_equivalence,
        op6_quality_ratio,
        op7_secret_ownership,
        op8_template_leaks,
        op9_sentencepiece_offsets,
        op10_near_copies,
        op11_curriculum_mix,
        op12_infill,
        op13_whitening,
    )
}
