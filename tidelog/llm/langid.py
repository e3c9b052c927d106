"""Language identification in two levels: the family first, then the language within it.

A text is a frequency vector of hashed runs of one to three bytes, with letters in lower case and
everything else as a space. Linear support vector machines, one for each pair of families, vote
for the family; one for each pair of languages of that family votes for the language.

Training takes at most `per_language` labelled rows of each language, chosen by a hash of the id;
only a few vectors of fixed length of each reach the driver. Prediction reads whole texts in Arrow
batches and keeps one sum per machine, however long a text is.

Cases: a NULL text, or one without a letter, is `und` with score 0; labels that are NULL are not
learned from; with a single learned language all texts with letters get it with score 1, with
none they are `und`. Repeated rows get equal predictions.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidelog.llm.words import text_or_empty

UNDETERMINED = "und"
DIMENSIONS = 2048
BLOCK_BYTES = 1 << 20
# Short pieces of a training text that are learned from besides the whole of it.
PIECE_LENGTHS = (30, 120)
PIECES = 2
# Families of languages that share an alphabet.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn mr gu pa ur ne".split(),
}
_FAMILY_OF = {language: family for family, members in FAMILIES.items() for language in members}


def family_of(language: str) -> str:
    """A language of no listed family is a family of its own."""
    return _FAMILY_OF.get(language.lower().split("-")[0], language)


def _byte_table() -> np.ndarray:
    """ASCII letters in lower case, bytes of other letters as they are, the rest as a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


_TABLE = _byte_table()
_APART = np.full(2, 32, np.uint8)


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the runs of one, two and three bytes that end at each byte."""
    b = _TABLE[data]
    if len(b) > 1:
        # Capital Latin letters with marks follow the byte C3.
        capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        b[1:][capital] += 0x20
    one = b.astype(np.uint32)
    before = np.concatenate(([np.uint32(32)], one[:-1]))
    earlier = np.concatenate(([np.uint32(32)], before[:-1]))
    two = before << np.uint32(8) | one
    three = earlier << np.uint32(16) | two
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    return (
        one,
        256 + ((two * np.uint32(2654435761)) >> shift) % np.uint32(DIMENSIONS - 256),
        256 + (((three ^ np.uint32(0x9E3779)) * np.uint32(2246822519)) >> shift) % np.uint32(DIMENSIONS - 256),
    )


def pieces_of(data: np.ndarray) -> list[np.ndarray]:
    """A whole text and a few short pieces spread over it, since short texts are asked for too."""
    found = [data]
    for length in PIECE_LENGTHS:
        if len(data) > 2 * length:
            step = (len(data) - length) // PIECES
            found += [data[begin : begin + length] for begin in range(0, step * PIECES, step)]
    return found


def vector(data: np.ndarray) -> np.ndarray:
    """Frequencies of the features of a text, block by block."""
    counts = np.zeros(DIMENSIONS)
    for begin in range(0, len(data), BLOCK_BYTES):
        for numbers in features(data[begin : begin + BLOCK_BYTES]):
            counts += np.bincount(numbers, minlength=DIMENSIONS)
    return counts / max(1, len(data))


@dataclass
class Machine:
    """A linear decision between two classes; positive sums speak for the first."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated gradient steps; y is 1 or -1.

    The bias is one more weight, of a feature that is always 1.
    """
    part = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    y = y.astype(x.dtype)
    # The largest curvature bounds the step.
    squares = np.einsum("ij,ij->i", x, x) + 1
    curvature = x.dtype.type(2 * (part * squares).sum() + penalty)
    w, bias = np.zeros(x.shape[1], x.dtype), x.dtype.type(0)
    ahead, bias_ahead = w, bias
    for step in range(steps):
        pull = part * y * np.maximum(0, 1 - y * (x @ ahead + bias_ahead))
        new = ahead - (penalty * ahead - 2 * (pull @ x)) / curvature
        new_bias = bias_ahead - (penalty * bias_ahead - 2 * pull.sum()) / curvature
        push = x.dtype.type(step / (step + 3))
        ahead, bias_ahead = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


@dataclass
class LanguageModel:
    """Machines between families, machines between languages of each family, all languages."""

    languages: list[str]
    families: list[str]
    between: list[Machine]
    within: dict[str, list[Machine]]

    @property
    def machines(self) -> list[Machine]:
        return [*self.between, *(m for ms in self.within.values() for m in ms)]


def train(x: np.ndarray, labels: list[str]) -> LanguageModel:
    """Machines of all levels from one vector per label; the vectors are scaled in place."""
    labels = np.array(labels, dtype=object)
    languages = sorted(set(labels))
    family = np.array([family_of(label) for label in labels], dtype=object)
    families = sorted(set(family))
    scale = (1 / np.maximum(x.std(0), 1e-4) if len(x) else np.ones(DIMENSIONS)).astype(np.float32)
    x *= scale

    def between(names: list[str], of: np.ndarray) -> list[Machine]:
        found = []
        for a, b in combinations(names, 2):
            some = (of == a) | (of == b)
            weights, bias = train_machine(x[some], np.where(of[some] == a, 1.0, -1.0))
            found.append(Machine(a, b, weights * scale, bias))
        return found

    within = {f: between(sorted(set(labels[family == f])), labels) for f in families}
    return LanguageModel(languages, families, between(families, family), within)


def _vote(names: list[str], machines: list[Machine], sums: dict[int, float]) -> tuple[str, float]:
    """The class with most won pairs, ties by the sum of margins; how sure its closest win is."""
    votes = {name: [0, 0.0] for name in names}
    sure = {name: 1.0 for name in names}
    for machine in machines:
        margin = sums[id(machine)]
        p = 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
        votes[machine.first if margin > 0 else machine.second][0] += 1
        votes[machine.first][1] += margin
        votes[machine.second][1] -= margin
        sure[machine.first] = min(sure[machine.first], p)
        sure[machine.second] = min(sure[machine.second], 1 - p)
    best = max(names, key=lambda name: (votes[name], name))
    return best, sure[best]


class Predictor:
    """Sums the weights of all machines over the bytes of texts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        machines = model.machines
        self.weights = [m.weights for m in machines]
        self.bias = np.array([m.bias for m in machines])

    def sums(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row per text, one column per machine. Blocks hold many short texts or a part of one."""
        total = np.zeros((len(texts), len(self.weights)))
        block: list[tuple[int, np.ndarray]] = []
        size = 0

        def add() -> None:
            # Spaces keep the runs of one text apart from its neighbour; they do not count.
            data = np.concatenate([x for _, part in block for x in (_APART, part)])
            ends = np.cumsum([len(part) + len(_APART) for _, part in block])
            starts = np.concatenate(([0], ends[:-1]))
            counted = np.ones(len(data), bool)
            for k in range(len(_APART)):
                counted[starts + k] = False
            rows = [row for row, _ in block]
            numbers = features(data)
            for k, w in enumerate(self.weights):
                per_byte = np.where(counted, w[numbers[0]] + w[numbers[1]] + w[numbers[2]], 0.0)
                np.add.at(total[:, k], rows, np.add.reduceat(per_byte, starts))

        for row, text in enumerate(texts):
            for begin in range(0, len(text), BLOCK_BYTES):
                part = text[begin : begin + BLOCK_BYTES]
                if block and size + len(part) > BLOCK_BYTES:
                    add()
                    block, size = [], 0
                block.append((row, part))
                size += len(part)
        if block:
            add()
        lengths = np.array([max(1, len(text)) for text in texts])
        return total / lengths[:, None] + self.bias

    def predict(self, texts: list[np.ndarray]) -> list[tuple[str, float]]:
        model = self.model
        if len(model.languages) < 2:
            return [(model.languages[0], 1.0) if model.languages else (UNDETERMINED, 0.0)] * len(texts)
        found = []
        machines = model.machines
        for row in self.sums(texts):
            by_machine = {id(m): float(s) for m, s in zip(machines, row, strict=True)}
            family, sure = _vote(model.families, model.between, by_machine)
            members = [name for name in model.languages if family_of(name) == family]
            language, surer = _vote(members, model.within[family], by_machine)
            found.append((language, float(min(sure, surer))))
        return found


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8) for v in column]


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a text and its pieces, one after the other, as the bytes of float32."""
    for batch in batches:
        rows = [
            b"".join(vector(piece).astype("<f4").tobytes() for piece in pieces_of(a))
            for a in _arrays(batch.column("text"))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("chance"), batch.column("label"), pa.array(rows, pa.binary())], ["chance", "label", "vectors"]
        )


def fit_languages(
    docs: DataFrame, per_language: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Learns from at most per_language rows of each language of the given rows."""
    labelled = docs.select(
        F.xxhash64(F.col(id_col).cast("string"), F.lit(5)).alias("chance"),
        F.col(lang_col).alias("label"),
        F.col(text_col).alias("text"),
    ).filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return train(np.zeros((0, DIMENSIONS), np.float32), [])
    # A chance that gives somewhat more than the bound; the bound itself cuts the rest.
    low = -(2**63)
    chance = F.lit(False)
    for label, n in sorted(counts.items()):
        part = min(1.0, 1.2 * per_language / n)
        chosen = F.col("chance") <= F.lit(min(2**63 - 1, low + int(part * 2**64)))
        chance = chance | ((F.col("label") == label) & chosen)
    sample = labelled.filter(chance).mapInArrow(_vectors, "chance bigint, label string, vectors binary")
    # The rows of each language with the lowest hashes, in whatever order they arrive.
    taken: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.toLocalIterator():
        own = taken.setdefault(row["label"], [])
        own.append((row["chance"], bytes(row["vectors"])))
        if len(own) >= 2 * per_language:
            own[:] = sorted(own)[:per_language]
    groups = [
        (label, np.frombuffer(vectors, "<f4").reshape(-1, DIMENSIONS))
        for label, group in sorted(taken.items())
        for _, vectors in sorted(group)[:per_language]
    ]
    labels = [label for label, vectors in groups for _ in vectors]
    return train(np.concatenate([vectors for _, vectors in groups]), labels)


def _predict(model: LanguageModel, text_of):
    """Adds lang_pred and score to the first column; text_of takes the texts out of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for batch in batches:
            found = predictor.predict(_arrays(text_of(batch)))
            lettered = batch.column("lettered").to_pylist()
            answers = [answer if ok else (UNDETERMINED, 0.0) for answer, ok in zip(found, lettered, strict=True)]
            languages = pa.array([language for language, _ in answers], pa.string())
            scores = pa.array([score for _, score in answers], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), languages, scores], [batch.schema.names[0], "lang_pred", "score"]
            )

    return run


def _predicted(rows: DataFrame, model: LanguageModel, text_of) -> DataFrame:
    schema = StructType(
        [rows.schema.fields[0], StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )
    return rows.mapInArrow(_predict(model, text_of), schema)


def _lettered(text_col: str) -> Column:
    return text_or_empty(F.col(text_col)).rlike(r"\p{L}").alias("lettered")


def predict_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, lang_pred and score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _lettered(text_col))
    return _predicted(rows, model, lambda batch: batch.column("text")).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def keep_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Documents whose language is found, with their own columns; the others go."""
    model = fit_languages(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.struct("*").alias("row"), _lettered(text_col))
    place = docs.columns.index(text_col)
    predicted = _predicted(rows, model, lambda batch: batch.column("row").field(place))
    return predicted.filter(F.col("lang_pred") != UNDETERMINED).select("row.*")
