"""Lexical index and search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import bm25_term, idf
from ..functions.text import TOKENIZERS, Tokenizer, mixed_tokens
from ..session import checkpointed
from ..sources.tables import exists, open_store


MOST_STOP_WORDS = 20_000  #: a longer list is joined instead of being put into the expression


def short_list(stop_words: DataFrame | list[str] | None) -> list[str] | DataFrame:
    """Stop words as a list, read once, if they are few enough for an expression; else as they are."""
    if stop_words is None or isinstance(stop_words, list):
        return stop_words or []
    words = [r[0] for r in stop_words.select(F.lower("word")).distinct().limit(MOST_STOP_WORDS + 1).collect()]
    return words if len(words) <= MOST_STOP_WORDS else stop_words


def kept_tokens(text: str, stop_words: DataFrame | list[str] | None, tokenizer: Tokenizer) -> Column | None:
    """The tokens of a text without stop words as one array expression; None if the list is too long for one."""
    tokens, words = tokenizer(F.col(text)), short_list(stop_words)
    if not isinstance(words, list):
        return None
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def tokens_of(df: DataFrame, key: list[str], text: str, stop_words: DataFrame | list[str] | None = None, tokenizer: Tokenizer = mixed_tokens) -> DataFrame:
    """(key…, term): one row a token occurrence, stop words dropped."""
    kept = kept_tokens(text, stop_words, tokenizer)
    if kept is not None:
        return df.select(*key, F.explode(kept).alias("term"))
    out = df.select(*key, F.explode(tokenizer(F.col(text))).alias("term"))
    return out.join(stop_words.select(F.lower("word").alias("term")).distinct(), "term", "left_anti").select(*key, "term")


BUCKETS = 64  #: parts of a saved index by the hash of the term; a search reads those of its terms


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Bm25Index:
    """Postings (term, doc_id, tf, dl, segment), document lengths (doc_id, dl, segment) and one row of corpus figures (n, avgdl).

    A posting carries the length of its document, so that a search joins nothing to it.  Only where an
    index has grown by segments are the lengths read: a document's names the segment that holds its
    postings, and those of older segments are out of date and drop out.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    tokenizer: Tokenizer = mixed_tokens
    stop_words: DataFrame | list[str] | None = None
    k1: float = 1.5
    b: float = 0.75
    bucketed: bool = False
    grown: bool = False

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, text: str, stop_words: DataFrame | None = None, tokenizer: Tokenizer = mixed_tokens, k1: float = 1.5, b: float = 0.75, segment: int = 0) -> Bm25Index:
        """Index of one row a document; documents without tokens count in ``n`` and ``avgdl``."""
        docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        stop_words = short_list(stop_words)
        kept = kept_tokens("text", stop_words, tokenizer)
        # all tokens of a document are in one task: the partial count leaves only postings to shuffle
        if kept is not None:  # lengths come straight from the rows
            lengths = docs.select("doc_id", F.size(kept).cast("long").alias("dl"))
            tokens = docs.select("doc_id", kept.alias("kept")).select("doc_id", F.size("kept").cast("long").alias("dl"), F.explode("kept").alias("term"))
            postings = tokens.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))
        else:
            postings = tokens_of(docs, ["doc_id"], "text", stop_words, tokenizer).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
            dl = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
            lengths = docs.select("doc_id").join(dl, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
            postings = postings.join(dl, "doc_id")
        number = F.lit(segment).alias("segment")
        return cls(postings.select("term", "doc_id", "tf", "dl", number), lengths.select("*", number), cls.figures(lengths), tokenizer, stop_words, k1, b)

    @staticmethod
    def figures(lengths: DataFrame) -> DataFrame:
        return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def search(self, queries: DataFrame, query_id: list[str], text: str, topk: int = 150, digits: int = 6) -> DataFrame:
        """(query_id…, doc_id, score, rank) of the best documents; a token repeated in a query counts each time.

        Of a saved index only the buckets of the asked terms are read; ties go to the smaller id.  A query
        without tokens has no rows.
        """
        asked = tokens_of(queries, query_id, text, self.stop_words, self.tokenizer).groupBy(*query_id, "term").agg(F.count("*").alias("qtf"))
        terms = asked.select("term").distinct()
        postings = self.postings
        if self.bucketed:  # at most BUCKETS numbers, which prune the folders that are read
            postings = postings.where(F.col("bucket").isin([r[0] for r in terms.select(_bucket().alias("bucket")).distinct().collect()]))
        hits = postings.join(terms, "term", "left_semi")
        if self.grown:
            hits = hits.join(self.lengths.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        figures = self.stats.first()
        n, avgdl = (figures["n"], figures["avgdl"]) if figures else (0, 0.0)
        weighted = asked.join(df, "term").withColumn("idf", idf(F.lit(float(n)), F.col("df")))
        one = F.col("qtf") * bm25_term(F.col("tf"), F.col("dl"), F.lit(float(avgdl)), F.col("idf"), self.k1, self.b)
        total = hits.join(weighted, "term").groupBy(*query_id, "doc_id").agg(F.round(F.sum(one), digits).alias("score"))
        w = Window.partitionBy(*query_id).orderBy(F.col("score").desc(), "doc_id")
        return total.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= topk)

    def save(self, path: str) -> None:
        """Three tables and the settings; postings lie in folders by the hash of the term, sorted by term."""
        self._write_postings(path, "overwrite")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        if self.stop_words:
            words = self.stop_words
            words = self.stats.sparkSession.createDataFrame([(w,) for w in words], "word string") if isinstance(words, list) else words
            words.select("word").write.mode("overwrite").parquet(f"{path}/stop_words")
        self._write_stats(path, self.figures(self.stats.sparkSession.read.parquet(f"{path}/lengths")), False)

    def _write_postings(self, path: str, mode: str) -> None:
        rows = self.postings.select("term", "doc_id", "tf", "dl", "segment", _bucket().alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")

    def _write_stats(self, path: str, stats: DataFrame, grown: bool) -> None:
        name = next((k for k, f in TOKENIZERS.items() if f is self.tokenizer), None)
        settings = {"k1": F.lit(self.k1), "b": F.lit(self.b), "tokenizer": F.lit(name).cast("string"), "grown": F.lit(grown)}
        stats.withColumns(settings).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer | None = None) -> Bm25Index:
        """A saved index with the tokenizer it was built with; one that is not in ``TOKENIZERS`` must be given again (ValueError)."""
        params = open_store(spark, f"{path}/stats").first()
        if tokenizer is None and params["tokenizer"] not in TOKENIZERS:
            raise ValueError("the index was built with a tokenizer of its own, which must be given")
        stop = short_list(spark.read.parquet(f"{path}/stop_words")) if exists(spark, f"{path}/stop_words") else None
        stats = open_store(spark, f"{path}/stats").select("n", "avgdl")
        return cls(open_store(spark, f"{path}/postings"), open_store(spark, f"{path}/lengths"), stats, tokenizer or TOKENIZERS[params["tokenizer"]], stop, params["k1"], params["b"], bucketed=True, grown=params["grown"])

    def add(self, path: str, docs: DataFrame, doc_id: str = "doc_id", text: str = "comment") -> Bm25Index:
        """The saved index at ``path``, with new or changed documents put into a segment of their own; what they replace is out of date from then on."""
        spark = docs.sparkSession
        old = spark.read.parquet(f"{path}/lengths")
        number = (old.agg(F.max("segment")).first()[0] or 0) + 1
        new = Bm25Index.build(docs, doc_id, text, self.stop_words, self.tokenizer, self.k1, self.b, number)
        lengths = checkpointed(old.join(new.lengths, "doc_id", "left_anti").unionByName(new.lengths))
        new._write_postings(path, "append")
        lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self._write_stats(path, self.figures(spark.read.parquet(f"{path}/lengths")), True)
        return Bm25Index.load(spark, path, self.tokenizer)

    @classmethod
    def load_or_build(cls, spark: SparkSession, path: str, docs: DataFrame | None, doc_id: str = "doc_id", text: str = "comment", **options: object) -> Bm25Index:
        """The saved index, or one built from ``docs`` and saved; neither is an error."""
        if not exists(spark, f"{path}/stats"):
            if docs is None:
                raise FileNotFoundError(path)
            cls.build(docs, doc_id, text, **options).save(path)
        return cls.load(spark, path, options.get("tokenizer"))
