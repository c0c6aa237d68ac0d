"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of a bounded sample of its labelled documents, in lower case:
the sample's whole texts are cut into passages, and passages from anywhere in them, by their hash, fill the dictionary.
A text is cut into pieces, each piece is compressed with every dictionary, and the language whose dictionary gives the
fewest bytes in all is chosen. If the runner-up is closer than MARGIN, the choice is marked as rejected.

score is the choice's share of 2 ** (-2 * bytes / pieces), so 1 / (number of languages) at a tie and towards 1 at a
wide margin. A null text and one without a letter give `und`, score 0, rejected. Ties go to the language with more
learned documents, then to the smaller name. Texts are read whole, a piece at a time. Repeated rows are judged each for
itself, and learned once; an empty table, or none with a label, gives an empty result or `und`. Only id and text are
read to predict, and the label to learn.

Every language with a label is learned. What is bounded is the labelled rows of a language (`sample`) and the bytes of
all dictionaries (`budget`), which many languages share; both are parameters of train.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 400  #: labelled documents of a language that are learned from, at most
DICTIONARY, BUDGET = 160_000, 64_000_000  #: characters of a language's dictionary, and of all together, at most
PASSAGE = 400  #: characters of a passage of a dictionary
PIECE = 1000  #: characters compressed at once
LEVEL = 6
MARGIN = 0.01  #: of the best size: a closer runner-up rejects the choice
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def train(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dictionary: int = DICTIONARY, budget: int = BUDGET) -> dict[str, bytes]:
    """language -> dictionary content, those with more labels first. allowed: of the rows, those to learn from. Rows
    without a letter are no labelled text. The sample is the documents of least id hash, a top-k in each task first."""
    rows = docs if allowed is None else docs.where(allowed)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    each = max(1, min(dictionary, budget // len(counts)) // PASSAGE)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.select("lang", "id").withColumn("nth", nth).where(F.col("nth") <= sample).select(F.col("lang").alias("of"), F.col("id").alias("wanted")).distinct()
    met = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & F.col("id").eqNullSafe(F.col("wanted"))).select("lang", "text")
    starts = F.expr(f"sequence(1, length(text), {PASSAGE})")
    passages = met.select("lang", F.explode(F.transform(starts, lambda i: F.lower(F.col("text").substr(i, F.lit(PASSAGE))))).alias("passage")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("passage"), "passage"))
    content: dict[str, list[str]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for lang, _, passage in sorted(passages.withColumn("place", place).where(F.col("place") <= each).select("lang", "place", "passage").collect()):
        content[lang].append(passage)
    return {lang: "\n".join(x).encode() for lang, x in content.items() if x}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # a window that reaches the whole dictionary from the end of a piece
            reach = max(17, (len(content) + 4 * PIECE).bit_length())
            settings = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), window_log=reach, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """language, score, margin, rejected"""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        text = text.lower()
        pieces = [text[a : a + PIECE].encode() for a in range(0, len(text), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        best = min(sizes)
        score = 1 / sum(2.0 ** (-min(1000.0, (s - best) * 2 / len(pieces))) for s in sizes)
        others = sorted(sizes)[1:2]
        margin = (others[0] - best) / best if others else 1.0
        return self.names[sizes.index(best)], score, margin, margin < MARGIN


@lru_cache(maxsize=2)
def _classifier(items: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(items))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))  # bounded by train's budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _classifier(shared.value).predict
        for batch in batches:
            rows = [predict(x.as_py()) for x in batch.column(1)]
            names, scores, margins, rejected = zip(*rows) if rows else ((), (), (), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return asked.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
