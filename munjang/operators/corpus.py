"""Building labelled corpora: cleaning, cutting, deduplicating, statistics and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from munjang.functions.text import document_id, normalize, strip, truncate
from munjang.sources.documents import read_documents, read_wiki_dump

# Limits of a document and of a paragraph, prompt templates and temperatures, the last month before large models.
MIN_CHARS, MAX_CHARS, PARAGRAPH_CHARS, HANGUL_SHARE = 400, 6000, 40, 0.35
TOPIC_CHARS = (10, 120)
PROMPTS = (
    "다음 주제로 한국어 글을 {n}자 내외로 써 줘.\n주제: {topic}",
    "당신은 칼럼니스트입니다. 다음 주제로 {n}자 분량의 칼럼을 작성하세요.\n주제: {topic}",
    "다음 주제에 대해 {n}자 정도의 한국어 설명문을 자연스럽게 작성해 주세요.\n주제: {topic}",
    "'{topic}'에 관해 {n}자 분량으로 정리해 주세요. 사람이 쓴 것처럼 자연스럽게요.",
    "블로그 글을 써 줘. 주제는 '{topic}', 길이는 {n}자 정도. 너무 딱딱하지 않게.",
)
TEMPERATURES = (0.3, 0.6, 0.8, 1.0)
CUTOFF = (2022, 11)
#: Fixed values too: wiki markup, expression and replacement, applied in this order, three times.
MARKUP = (
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^>]*/>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\[\[(?:파일|File|Image|분류|Category):[^\]]*\]\]", ""),
    (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
    (r"\[\[([^\]]*)\]\]", "$1"),
    (r"'{2,}", ""),
    (r"(?dm)^[=]{2,}.*?[=]{2,}\s*$", ""),
    (r"(?dm)^[*#:;].*$", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"(?U)https?://\S+", ""),
    (r"<[^>]+>", ""),
)


def hangul_share(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit("[가-힣]")).cast("double"), F.length(c).cast("double")), F.lit(0.0))


def clean_wikitext(c: Column | str, rounds: int = 3) -> Column:
    """Plain paragraphs of a wiki page: markup goes, then short and mostly non-Hangul lines."""
    t = F.col(c) if isinstance(c, str) else c
    for _ in range(rounds):
        for rx, to in MARKUP:
            t = F.regexp_replace(t, rx, to)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(t, "\n"), strip)
    return F.array_join(F.filter(lines, lambda p: (F.length(p) >= PARAGRAPH_CHARS) & (hangul_share(p) >= HANGUL_SHARE)), "\n\n")


def wiki_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(title, text) of articles of a dump (title, ns, text): main namespace, no redirects, cleaned, long enough."""
    redirect = F.contains(F.upper(F.substring("text", 1, 40)), F.lit("#REDIRECT")) | F.startswith(F.ltrim("text"), F.lit("#넘겨주기"))
    kept = pages.where((F.col("ns") == 0) & (F.coalesce("text", F.lit("")) != "") & ~redirect).select("title", clean_wikitext("text").alias("text")).where(F.length("text") >= MIN_CHARS)
    return kept.limit(limit) if limit else kept


def dump_allowed(name: Column | str) -> Column:
    """Whether a dump's name shows a month up to the cutoff; true where it shows none."""
    c = F.col(name) if isinstance(name, str) else name
    year, month = (F.nullif(F.regexp_extract(c, r"(20\d{2})(\d{2})\d{2}", i), F.lit("")).cast("int") for i in (1, 2))
    return F.coalesce((year * 100 + month) <= CUTOFF[0] * 100 + CUTOFF[1], F.lit(True))


def admit(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(label, genre, doc_id, text) of new documents: cut, normalised, long enough, one for each text and label.

    Of equal texts of one label the one of the smallest genre stays; texts that
    ``existing`` (label, doc_id) holds do not come again.
    """
    ready = docs.select("label", "genre", normalize(truncate("text", MAX_CHARS)).alias("text")).where(F.length("text") >= MIN_CHARS).withColumn("doc_id", document_id("text"))
    one = ready.groupBy("label", "doc_id").agg(F.min_by(F.struct("genre", "text"), F.struct("genre", "text")).alias("d")).select("label", "d.genre", "doc_id", "d.text")
    return one if existing is None else one.join(existing.select("label", "doc_id"), ["label", "doc_id"], "left_anti")


def save(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").partitionBy("label", "genre").parquet(path)


def statistics(corpus: DataFrame) -> DataFrame:
    """Documents and mean characters (bytes / 3) by label and genre, with totals as nulls."""
    return corpus.rollup("label", "genre").agg(F.count("*").alias("n"), (F.avg(F.octet_length("text")) / 3).alias("mean_chars"))


def genre_of_path(path: Column | str) -> Column:
    """What stands before ``__`` in a file name, else essay."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.nullif(F.regexp_extract(c, r"([^/]*?)__[^/]*$", 1), F.lit("")), F.lit("essay"))


def import_files(spark: SparkSession, paths: list[str], label: str, genre: str = "essay", before_models: bool = False, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents to save, files that failed) of folders and files of every supported kind; a path that is named twice is read once.

    Human documents are taken only where the caller vouches that they were
    written before large language models (``before_models``).
    """
    if label == "human" and not before_models:
        raise ValueError("human documents need before_models=True: their texts must be older than large language models")
    found = read_documents(spark, sorted(set(paths)))
    read = found.where("error IS NULL").select(F.lit(label).alias("label"), F.lit(genre).alias("genre"), "text")
    return admit(read, existing), found.where("error IS NOT NULL").select("path", "error")


def import_wiki(spark: SparkSession, path: str, label: str, genre: str = "report", limit: int | None = None, force: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """Documents to save from a dump: of a month up to the cutoff unless forced, and no more than ``limit``."""
    if not force and not spark.range(1).select(dump_allowed(F.lit(path)).alias("ok")).first()["ok"]:
        raise ValueError(f"{path} is younger than {CUTOFF[0]}-{CUTOFF[1]:02d}")
    pages = wiki_pages(read_wiki_dump(spark, path)).select(F.lit(label).alias("label"), F.lit(genre).alias("genre"), "text")
    kept = admit(pages, existing)
    return kept.limit(limit) if limit else kept


def topics_of_file(spark: SparkSession, path: str) -> DataFrame:
    """(topic): the lines of a text file that are not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("topic")).where("topic <> ''")


def topics(corpus: DataFrame) -> DataFrame:
    """(doc_id, topic): the first sentence of each document's first 300 characters, if of fitting length."""
    first = F.split(strip(F.substring("text", 1, 300)), r"(?U)(?<=[.!?])\s")[0]
    return corpus.select("doc_id", first.alias("topic")).where(F.length("topic").between(*TOPIC_CHARS))


def generation_prompts(topics: DataFrame, count: int, length: int = 900) -> DataFrame:
    """(i, topic, prompt, temperature): topics in turn, template and temperature drawn from a hash of i."""
    spark = topics.sparkSession
    # No more topics are numbered than prompts are asked for, whatever the corpus holds.
    wanted_topics = topics.select("topic").distinct().orderBy("topic").limit(count)
    numbered = wanted_topics.withColumn("k", F.row_number().over(Window.orderBy("topic")) - 1)
    n = numbered.count()
    if not n:
        return spark.createDataFrame([], "i long, topic string, prompt string, temperature double")
    wanted = spark.range(count).select(F.col("id").alias("i"), (F.col("id") % n).cast("int").alias("k"))
    template = F.element_at(F.array(*map(F.lit, PROMPTS)), (F.pmod(F.xxhash64("i", F.lit(1)), F.lit(len(PROMPTS))) + 1).cast("int"))
    temperature = F.element_at(F.array(*map(F.lit, TEMPERATURES)), (F.pmod(F.xxhash64("i", F.lit(2)), F.lit(len(TEMPERATURES))) + 1).cast("int"))
    prompt = F.replace(F.replace(template, F.lit("{topic}"), F.col("topic")), F.lit("{n}"), F.lit(str(length)))
    return wanted.join(numbered, "k").select("i", "topic", prompt.alias("prompt"), temperature.alias("temperature"))


def adversarial(docs: DataFrame, level: str = "aggressive") -> DataFrame:
    """(doc_id, genre, text) of documents as the rules rewrite them; rewrites that were given up are left out."""
    from munjang.operators.rewrite import polish

    return polish(docs, level, scores=False).where("NOT aborted").select("doc_id", "genre", "text")


def classes(human: DataFrame, machine: DataFrame) -> DataFrame:
    """Both corpora as one table with label 0 and 1."""
    return human.withColumn("label", F.lit(0)).unionByName(machine.withColumn("label", F.lit(1)))
