"""Cleaning documents for training: five stages, each working on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic.llm import langid, nearcopies, pieces, secrets, templates
from cytomosaic.llm.common import Workspace, table
from cytomosaic.llm.queries import model_bytes, sha256

#: Share of a document's letters that its language must have.
LEAST_SCORE = 0.5
#: Keys sent to every task up to this many rows (about 100 bytes each), joined by a shuffle beyond.
SENT_KEYS = 500_000
MASK = "[SECRET]"
MODEL = "piece_bpe_32k.model"


def sized(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def text_key() -> Column:
    """What a text is known by where ids may be null or repeated."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(f"{mark}{name}" in taken for name in names):
        mark += "_"
    return [f"{mark}{name}" for name in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that state their language; texts of no language, or of several with none in half, go.

    A missing language is filled in. Documents that state one keep it.
    """
    model = langid.train(docs)
    lang, score, spans = unused(docs, "lang", "score", "spans")
    labelled = langid.label(docs, model, keep_text=True, out=(lang, score, spans))
    kept = labelled.filter((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 in five-word shingles, the one with the least id stays.

    Of rows that share an id, the one with the least text stays. Rows without an id stay.
    """
    ws = Workspace(spark, "dedup")
    judged = ws.keep(nearcopies.near_copies(docs), "judged")
    gone = judged.filter("NOT kept").select("doc_id").distinct()
    left = docs.join(sized(gone), "doc_id", "left_anti")
    twice = judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = ws.keep(twice, "twice")
    if twice.isEmpty():
        return left.select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", *rest)
    one = left.join(sized(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return left.join(sized(twice), "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark is found, as it is or with other names and numbers, go.

    Null and empty texts contain no item, and an empty benchmark or table takes none away.
    """
    ws = Workspace(spark, "leaks")
    (key,) = unused(docs, "key")
    found = templates.contaminated(docs.select(text_key().alias(key), "text"), table(spark, sf_dir, "benchmark"), key=key)
    gone = ws.keep(found.select(key).distinct(), "found")
    return docs.withColumn(key, text_key()).join(sized(gone), key, "left_anti").select(*docs.columns)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced; spans come by start and may overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        between = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.when(fresh, F.concat(done["out"], between, F.lit(MASK))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced by a mark, except values that many texts of many sources share: these are examples and stay.

    Null and empty texts, and texts without a span, stay as they are.
    """
    ws = Workspace(spark, "masks")
    key, mine = unused(docs, "key", "mine")
    found = secrets.scan(docs.select(text_key().alias(key), "text", "source"), keep=[key], owner="source")
    live = F.filter("found", lambda f: f["live"])
    spans = F.transform(live, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    # a text's spans are the same wherever it stands
    rows = ws.keep(found.select(key, spans.alias(mine)).filter(F.size(mine) > 0).dropDuplicates([key]), "spans")
    joined = docs.withColumn(key, text_key()).join(sized(rows), key, "left")
    text = F.when(F.col(mine).isNotNull(), masked(F.col("text"), F.col(mine))).otherwise(F.col("text"))
    size = F.when(F.col(mine).isNotNull(), F.length(text)).otherwise(F.col("n_chars"))
    return joined.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).withColumn("text", text).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends, decoded_sha256): pieces with their source bytes, and a hash of the decoded text.

    A null or empty text has no pieces; an empty table gives an empty one.
    """
    model = model_bytes(MODEL)
    encoded = pieces.encode(docs, model, decoded="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", sha256(F.col("decoded")).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_masking", mask_secrets),
    ("sentencepiece", encode),
]
#: SQL can state none of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
