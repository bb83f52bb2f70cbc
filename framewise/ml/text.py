"""Text transformers: tokens, stop words, n-grams, counts and tf-idf."""

from __future__ import annotations

from collections.abc import Sequence

from framewise.ml.base import Column, DataFrame, F, Frame, Model, emit, names, spark_df, x

#: Fixed value: words of two or more word characters, in Java's spelling.
WORDS = r"(?U)\b\w\w+\b"
#: The usual English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


class RegexTokenizer(Model):
    """Matches of ``pattern`` longer than ``min_token_length``."""

    suffix = "_token"

    def __init__(self, pattern: str = r"\s+", min_token_length: int = 2, to_lowercase: bool = True) -> None:
        self.pattern, self.min_token_length, self.to_lowercase = pattern, min_token_length, to_lowercase

    def tokens(self, c: Column) -> Column:
        text = F.lower(c) if self.to_lowercase else c
        return F.filter(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), lambda t: F.length(t) > self.min_token_length)

    def fit(self, data, input_col=None):
        self.input_col = input_col
        return self

    def transform(self, data: Frame, input_col: str | None = None, output_col: str | None = None) -> Frame:
        c = input_col or self.input_col
        return emit(spark_df(data), {output_col or c + self.suffix: self.tokens(x(c))})


class Tokenizer(RegexTokenizer):
    """Words of two or more characters, those longer than ``min_token_length``."""

    suffix = "_tokens"

    def __init__(self, min_token_length: int = 2, to_lowercase: bool = True) -> None:
        super().__init__(WORDS, min_token_length, to_lowercase)


class RemoveStopWords(Model):
    """Tokens that are no stop words, each once, in order of first occurrence."""

    def __init__(self, case_sensitive: bool = True, stops_words_list: Sequence[str] | None = None, language: str | None = None) -> None:
        self.case_sensitive, self.words = case_sensitive, list(stops_words_list or [])
        if language:
            self.words += STOP_WORDS if language == "english" else _language_words(language)

    def stopwords_from_frame(self, data: Frame, input_col: str) -> "RemoveStopWords":
        """Stop words from a column of words (or of word lists)."""
        df = spark_df(data)
        c = x(input_col)
        if dict(df.dtypes)[input_col].startswith("array"):
            c = F.explode(c)
        self.words += [r["w"] for r in df.select(c.alias("w")).where("w is not null").distinct().limit(100_001).collect()]
        if len(self.words) > 100_000:
            raise ValueError("more than 100,000 stop words")
        return self

    def fit(self, data, input_col=None):
        self.input_col = input_col
        return self

    def transform(self, data: Frame, input_col: str | None = None, output_col: str | None = None) -> Frame:
        c = input_col or self.input_col
        words = self.words if self.case_sensitive else [w.lower() for w in self.words]
        stops = F.array(*[F.lit(w) for w in dict.fromkeys(words)]) if words else F.array().cast("array<string>")
        if self.case_sensitive:
            kept = F.array_except(x(c), stops)
        else:
            kept = F.array_distinct(F.filter(x(c), lambda t: ~F.array_contains(stops, F.lower(t))))
        return emit(spark_df(data), {output_col or f"{c}_rm_stopwords": kept})


def _language_words(language: str) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(language))


class NGram(Model):
    """Runs of ``n`` tokens joined by spaces."""

    def __init__(self, n: int = 2) -> None:
        if n < 1:
            raise ValueError("n is at least 1")
        self.n = n

    def fit(self, data, input_col=None):
        self.input_col = input_col
        return self

    def transform(self, data: Frame, input_col: str | None = None, output_col: str | None = None) -> Frame:
        c = input_col or self.input_col
        last = F.size(x(c)) - self.n + 1
        grams = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(x(c), i, self.n), " "))).when(x(c).isNotNull(), F.array().cast("array<string>"))
        return emit(spark_df(data), {output_col or f"{c}_ngram": grams})


def _tokens(df: DataFrame, c: str) -> Column:
    return x(c) if dict(df.dtypes)[c].startswith("array") else RegexTokenizer(WORDS, 0).tokens(x(c))


class CountVectorizer(Model):
    """Counts (``binary``: presence) of the most frequent terms, one column per term.

    Terms in at least ``min_df`` documents with at least ``min_tf`` occurrences in all; the ``vocab_size``
    most frequent of them (ties in alphabetical order), in alphabetical order. One pass: document and term counts are
    one map-side aggregate over exploded tokens.
    """

    parameters = ("input_col", "vocabulary")

    def __init__(self, vocab_size: int = 200, min_tf: float = 1.0, min_df: int = 1, binary: bool = True) -> None:
        self.vocab_size, self.min_tf, self.min_df, self.binary = vocab_size, min_tf, min_df, binary
        self.input_col = self.vocabulary = self.doc_freq = self.n_docs = None

    def fit(self, data: Frame, input_col: Sequence[str] | str):
        self.input_col = names(input_col)[0]
        df = spark_df(data)
        tokens = df.select(_tokens(df, self.input_col).alias("ts"))
        every = tokens.select(F.explode("ts").alias("w"), F.lit(1).alias("tf"), F.lit(0).alias("df"))
        once = tokens.select(F.explode(F.array_distinct("ts")).alias("w"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
        terms = every.union(once).groupBy("w").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where((F.col("df") >= self.min_df) & (F.col("tf") >= self.min_tf))
        best = sorted(terms.orderBy(F.desc("tf"), "w").limit(self.vocab_size).collect(), key=lambda r: r["w"])
        self.vocabulary, self.doc_freq, self.n_docs = [r["w"] for r in best], [r["df"] for r in best], df.count()
        return self

    def _counted(self, df: DataFrame) -> DataFrame:
        """``df`` with the counts of the vocabulary's terms as the array ``__fw_vector``: each token is looked up once in a hash table."""
        if not self.vocabulary:
            return df.withColumn("__fw_vector", F.array())
        from pyspark.ml.feature import CountVectorizerModel
        from pyspark.ml.functions import vector_to_array

        tokens = F.filter(F.coalesce(_tokens(df, self.input_col), F.array().cast("array<string>")), lambda t: t.isNotNull())
        counter = CountVectorizerModel.from_vocabulary(list(self.vocabulary), inputCol="__fw_tokens", outputCol="__fw_counts")
        counted = counter.transform(df.withColumn("__fw_tokens", tokens))
        return counted.withColumn("__fw_vector", vector_to_array("__fw_counts").cast("array<int>")).drop("__fw_tokens", "__fw_counts")

    def _vectors(self, work: DataFrame) -> DataFrame:
        return work.withColumn("__fw_vector", F.transform("__fw_vector", lambda n: (n > 0).cast("int"))) if self.binary else work

    def transform(self, data: Frame, input_col=None, output_col: str | None = None, remove: bool = False) -> Frame:
        self.check_fitted()
        if input_col:
            self.input_col = names(input_col)[0]
        df, out = spark_df(data), output_col or f"{self.input_col}_vectorized"
        work = self._vectors(self._counted(df))
        keep = [x(c) for c in df.columns if not (remove and c == self.input_col)]
        return Frame(work.select(*keep, *[F.col("__fw_vector")[i].alias(f"{out}{i}") for i in range(len(self.vocabulary))]))


class TfidfVectorizer(CountVectorizer):
    """tf x (ln((n + 1) / (df + 1)) + 1), each document scaled to length 1."""

    def __init__(self, vocab_size: int = 200, min_tf: float = 1.0, min_df: int = 1) -> None:
        super().__init__(vocab_size, min_tf, min_df, binary=False)

    def _vectors(self, work: DataFrame) -> DataFrame:
        import math

        if not self.vocabulary:
            return work
        idf = F.array(*[F.lit(math.log((self.n_docs + 1) / (d + 1)) + 1) for d in self.doc_freq])
        work = work.withColumn("__fw_vector", F.zip_with("__fw_vector", idf, lambda n, w: n * w))
        work = work.withColumn("__fw_norm", F.sqrt(F.aggregate("__fw_vector", F.lit(0.0), lambda a, v: a + v * v)))
        return work.withColumn("__fw_vector", F.transform("__fw_vector", lambda v: F.when(F.col("__fw_norm") > 0, v / F.col("__fw_norm")).otherwise(F.lit(0.0))))
