"""Token counts from a cache of digests.

A text's content is brought to a normal form that the tokenizer cannot tell
from the text, and digested. The cache is a table of digests and counts per
version of a tokenizer. Contents of the documents that the cache lacks are
encoded once each, however many documents hold them, and appended; then every
document finds its count by its digest. Only digests are joined; a text is
shuffled only if its count is missing, and copies of it meet before that.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrain.llm.common import parts_of, stored, within

FEW = 1 << 17  # digests that may be broadcast, 32 bytes each


def _library(path: str) -> str:
    if path.endswith(".json"):
        return "tokenizers"
    if path.endswith(".model"):
        return "sentencepiece"
    raise ValueError(f"no library is known for {path}")


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: a digest of its file and its library's release."""
    library = _library(path)
    with open(path, "rb") as file:
        own = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{own} {library} {version(library)}".encode()).hexdigest()


def normal_content(text: Column, path: str) -> Column:
    """The text in a form with the same tokens; null is empty.

    Where the file says that letters are lower-cased and runs of white space
    become one space, texts of ASCII alone are brought to that form here; in
    other texts case and white space can change how characters combine. A text
    that holds the string of an added token, now or in that form, is left as it
    is, for these are found before the file's rules apply.
    """
    text = F.coalesce(text, F.lit(""))
    if _library(path) != "tokenizers":
        return text
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    rules = spec.get("normalizer") or {}
    rules = rules.get("normalizers", [rules])
    if any(r.get("type") not in ("NFC", "NFKC", "Lowercase", "Replace") for r in rules):
        return text
    replaced = [r for r in rules if r["type"] == "Replace"]
    if any((r["pattern"], r["content"]) != ({"Regex": r"\s+"}, " ") for r in replaced):
        return text
    form = text
    if any(r["type"] == "Lowercase" for r in rules):
        form = F.lower(form)
    if replaced:
        form = F.regexp_replace(form, r"[\t\n\r ]+", " ")
    plain = F.octet_length(text) == F.char_length(text)
    for token in spec.get("added_tokens", []):
        plain &= ~F.contains(text, F.lit(token["content"])) & ~F.contains(form, F.lit(token["content"]))
    return F.when(plain, form).otherwise(text)


# Fixed value: the rule by which the word-end vocabulary finds words; no match holds white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
REMEMBERED, LONGEST_KNOWN = 400_000, 64  # words per process, characters of each


def parts_at_space(spec: dict) -> bool:
    """Whether a text has the tokens of its stretches between spaces, tabs and line ends: no rule of the file reaches across those."""
    rules = spec.get("normalizer") or {"normalizers": []}
    rules = rules.get("normalizers", [rules])
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    return (
        all(r["type"] in ("NFC", "Lowercase") or (r["type"], r.get("pattern"), r.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for r in rules)
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORDS}, "Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r") for t in spec.get("added_tokens", []))
    )


@cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens without begin, end or added special tokens; one per file and process.

    Where the file allows, each distinct stretch between white space is encoded
    once and its count remembered, as long as there is room.
    """
    if _library(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    with open(path, encoding="utf-8") as file:
        apart = parts_at_space(json.load(file))
    known = {"": 0}

    def whole(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    def by_stretch(texts: list[str]) -> list[int]:
        cuts = [t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t in texts]
        new = sorted(set().union(*cuts).difference(known))
        found = dict(zip(new, whole(new), strict=True))
        known.update(found)
        counts = [sum(map(known.__getitem__, words)) for words in cuts]
        full = len(known) > REMEMBERED
        for word in new:
            if full or len(word) > LONGEST_KNOWN:
                del known[word]
        return counts

    return by_stretch if apart else whole


COUNTS = "digest binary, n_tokens long"


def cached(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` of a tokenizer's version, each digest once; runs that appended at one time may have written one twice."""
    try:
        found = spark.read.schema(COUNTS).parquet(f"{folder}/{tokenizer}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTS)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """``digest, n_tokens`` for each row of ``texts(digest, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in parts_of(batches, "content", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(count(part.column("content").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(run, COUNTS)


def token_counts(docs: DataFrame, path: str, folder: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    path: a tokenizer's file, .json for the tokenizers library or .model for
    sentencepiece. folder: the cache, which every executor must reach; it need
    not exist. Null texts are empty: no bytes and what the library gives for an
    empty text. Rows are answered one by one, so null and repeated doc_ids change
    nothing; an empty table gives no rows and appends none. Other columns are not
    read. A run that fails before its append is done leaves no counts behind.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(path)
    text = F.col("text").cast("string")
    content = docs.select(normal_content(text, path).alias("content"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), normal_content(text, path).alias("content"))
    digest = F.unhex(F.sha2("content", 256)).alias("digest")
    keyed = stored(own.select("doc_id", "n_bytes", digest), "digests")
    known = cached(spark, folder, tokenizer)
    missing = stored(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
    few = within(missing, FEW)
    texts = content.select(digest, "content")
    if few is not missing:  # sent to the texts; only those missing are shuffled
        texts = texts.join(few, "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
    if few is missing:
        texts = texts.join(missing, "digest", "left_semi")
    _encoded(texts, path).write.mode("append").parquet(f"{folder}/{tokenizer}")
    counts = keyed.join(cached(spark, folder, tokenizer), "digest", "left")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
