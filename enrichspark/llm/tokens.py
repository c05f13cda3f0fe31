"""Token counts of texts, through a cache of digests.

A text is known by two digests: that of its normalised content, and that of the tokenizer's version (its file, library and
options). Counts are looked up by both. Only contents the cache lacks are encoded, each distinct one once however many
rows hold it, and their counts are appended, so that a later run over more texts encodes only what is new.

Digests are computed where the texts lie. What moves is digests, and the texts that have to be encoded; copies within a
task are folded before they move, so a content that a third of all rows hold is one row of each task.
"""

from __future__ import annotations

import hashlib
import importlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark.llm.common import map_texts, stored
from enrichspark.session import scratch_path

BLANKS = r"[ \t\n\x0B\f\r]+"  # white space to every tokenizer; also what bytes.split() splits at
MEMO = 1 << 18  # words whose counts a task remembers
COUNTS = "digest binary, n_tokens long"
LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece"}


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer's file and how it is used. `words`: white space separates tokens and gives none itself, so that any run
    of it is like one blank and the count of a text is the sum over its words."""

    library: str
    data: bytes
    words: bool = False

    @property
    def version(self) -> str:
        release = importlib.import_module(self.library).__version__
        return hashlib.sha256(repr((self.library, release, self.words)).encode() + self.data).hexdigest()

    def content(self, text: Column) -> Column:
        """The normalised content: texts that share it have the same number of tokens."""
        text = F.coalesce(text.cast("string"), F.lit(""))
        return F.trim(F.regexp_replace(text, BLANKS, " ")) if self.words else text

    def encoder(self):
        """A function from texts to their numbers of tokens, without added tokens, truncation or padding."""
        if self.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        import tokenizers

        model = tokenizers.Tokenizer.from_str(self.data.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def counter(self):
        """Like `encoder`; with `words` each distinct word is encoded once while it is remembered."""
        encode = self.encoder()
        if not self.words:
            return encode
        memo: dict[bytes, int] = {}

        def count(texts):
            out = []
            for text in texts:
                words = text.encode().split()
                new = [w for w in dict.fromkeys(words) if w not in memo]
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = list(dict.fromkeys(words))
                for k in range(0, len(new), 1 << 14):  # bounds what the library holds at a time
                    some = new[k : k + (1 << 14)]
                    memo.update(zip(some, encode([w.decode() for w in some])))
                out.append(sum(map(memo.__getitem__, words)))
            return out

        return count


def load(path: str, words: bool = False) -> Tokenizer:
    """The tokenizer in a file that the driver can read; executors get its bytes, a few MB for any vocabulary."""
    return Tokenizer(LIBRARIES[Path(path).suffix], Path(path).read_bytes(), words)


def cached(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) known of this tokenizer version: once each, though jobs side by side may have appended both."""
    path = f"{cache}/version={tokenizer.version}"
    spark.createDataFrame([], COUNTS).write.mode("append").parquet(path)  # there is a folder to read from now on
    return spark.read.schema(COUNTS).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(
    docs: DataFrame, misses: DataFrame, n_misses: int, n_wanted: int, tokenizer: Tokenizer, text: str, broadcast_rows: int
) -> DataFrame:
    """(digest, n_tokens) of the contents whose digests are in `misses`, each encoded once."""
    content = tokenizer.content(F.col(text))
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    few = n_misses <= broadcast_rows and n_misses < n_wanted
    if few:  # known contents stay where they are
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
    if not few and n_misses < n_wanted:  # dealt by digest already
        texts = texts.join(misses, "digest", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        count = shared.value.counter()
        return lambda texts: [count(texts)]

    return map_texts(texts, "content", [F.col("digest")], "n_tokens long", make, 1 << 19)


def count_tokens(
    docs: DataFrame,
    tokenizer: Tokenizer,
    cache: str,
    key: str = "doc_id",
    text: str = "text",
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of `docs`, and new counts in the folder `cache`.

    NULL texts count as empty ones: no byte, no token. Rows without id and repeated rows are counted like others; other
    columns are not read. An empty table gives an empty one. Texts are counted whole. The cache must lie where all
    executors reach it; a run that fails has appended nothing or what is right, so it may be run again.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(tokenizer.content(F.col(text)), 256))
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    marked = stored(docs.select(F.col(key).alias("id"), size.alias("n_bytes"), digest.alias("digest")), "tokens-digests")
    wanted = stored(marked.select("digest").distinct(), "tokens-wanted")
    hits = stored(cached(spark, cache, tokenizer).join(wanted, "digest", "left_semi"), "tokens-hits")
    misses = stored(wanted.join(hits, "digest", "left_anti"), "tokens-misses")
    n_misses = misses.count()
    counts = hits
    if n_misses:
        fresh = stored(encoded(docs, misses, n_misses, wanted.count(), tokenizer, text, broadcast_rows), "tokens-fresh")
        fresh.write.mode("append").parquet(f"{cache}/version={tokenizer.version}")
        counts = hits.union(fresh)
    return marked.join(counts, "digest").select("id", "n_bytes", "n_tokens")


def op11_token_counts(docs: DataFrame, cache: str | None = None, most: int = 2048) -> DataFrame:
    """Counts with a public vocabulary; by default with a cache of this run's own, so that nothing is skipped."""
    import public_tokenizers

    tokenizer = load(public_tokenizers.path("word_bpe_49k.json"), words=True)
    found = count_tokens(docs, tokenizer, cache or scratch_path(docs.sparkSession, "token-cache"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
