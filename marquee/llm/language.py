"""Language identification by hierarchical discrimination.

Step one picks the language family with one linear support vector machine per
family (one against the rest). Step two separates the languages of that family
with one machine for every two of them; each votes, and ties go to the larger sum
of margins. Features are the frequencies of hashed byte trigrams over the letters
of the whole text. Both steps are sums over trigrams, so a text of any length is
scored in one pass with a small table.

The machines are fitted on a bounded sample: at most ``PER_LANGUAGE`` documents of
a language and ``SAMPLE`` in all. Everything else runs over all documents.

Edge cases: a null text, an empty one and one without any letter are ``und`` with
score 0; so is every text if nothing was learned. With one learned language that
is the answer. Repeated rows get a row each; an empty table gives no rows.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import svm
from marquee.llm.common import documents, id_bucket, in_slices, only, slices, sums, texts_of

UNKNOWN = "und"
#: Bounds of the training sample, in documents.
PER_LANGUAGE, SAMPLE = 600, 4000
BITS = 13
#: Text handled at once inside a task, in bytes; its trigrams take some twenty times that.
SLICE = 2 << 20

# Families of related languages. Any other language is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "malayic": ["id", "jv", "ms", "su", "tl"],
}


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"={language}")


def letter_table() -> np.ndarray:
    """ASCII letters in lower case and all bytes of longer characters; anything else is a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for low in range(97, 123):
        table[low] = table[low - 32] = low
    return table


TABLE = letter_table()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and the offsets of the texts; runs of spaces count as one."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(texts)
    # A space stands before, between and after the texts.
    line = np.full(len(data) + n + 1, 32, np.uint8)
    gaps = offsets + np.arange(n + 1)
    inside = np.ones(len(line), bool)
    inside[gaps] = False
    line[inside] = TABLE[data]
    # Latin capitals with accents have the second byte 0x80 to 0x9e after 0xc3 (0x97 is no letter).
    capital = (line[:-1] == 0xC3) & (line[1:] >= 0x80) & (line[1:] <= 0x9E) & (line[1:] != 0x97)
    line[1:][capital] += 32
    kept = np.ones(len(line), bool)
    kept[1:] = (line[1:] != 32) | (line[:-1] != 32)
    place = (np.cumsum(kept) - 1)[gaps]
    line = line[kept].astype(np.uint32)
    if len(line) < 3:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    codes = line[:-2] | line[1:-1] << 8 | line[2:] << 16
    hashed = (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    # The trigrams that start at a text's last letter reach into the next text.
    own = np.ones(len(hashed), bool)
    crossing = place[1:-1] - 1
    own[crossing[(crossing >= 0) & (crossing < len(own))]] = False
    counts = np.maximum(np.diff(place) - 1, 0)
    return hashed[own], np.concatenate([[0], np.cumsum(counts)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, and the machines: columns of ``weights`` with the classes that they tell apart."""

    languages: list[str]
    families: list[str]
    #: For each column either a family (against the rest) or two languages.
    columns: list[tuple[str, ...]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashed, offsets = trigrams(texts)
        n, sizes = len(texts), np.diff(offsets)
        if not self.languages:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        margins = np.column_stack([sums(self.weights[hashed, c], offsets) for c in range(len(self.columns))]) if self.columns else np.zeros((n, 0))
        margins = margins / np.maximum(sizes, 1)[:, None] + self.bias
        column = {name: margins[:, c] for c, name in enumerate(self.columns)}
        against_rest = np.column_stack([column.get((f,), np.full(n, np.inf)) for f in self.families])
        family = against_rest.argmax(axis=1)
        sure, best = against_rest.max(axis=1), np.zeros(n, int)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            members = [x for x in self.languages if family_of(x) == name]
            votes, total, least = (np.zeros((len(rows), len(members))) for _ in range(3))
            least[:] = np.inf
            for a, b in combinations(range(len(members)), 2):
                m = column[members[a], members[b]][rows]
                for side, s in ((a, m), (b, -m)):
                    votes[:, side] += s > 0
                    total[:, side] += s
                    least[:, side] = np.minimum(least[:, side], s)
            winner = (votes + 0.5 * np.tanh(total) / max(len(members), 1)).argmax(axis=1)
            best[rows] = np.array([self.languages.index(x) for x in members])[winner]
            sure[rows] = np.minimum(sure[rows], least[np.arange(len(rows)), winner])
        answer = np.array(self.languages, object)[best]
        score = 1 / (1 + np.exp(-2 * np.clip(sure, -15, 15)))
        # Only texts without an ASCII letter need a look at each of their characters.
        for i in np.flatnonzero(sizes == 0).tolist() + self._doubtful(texts, sizes):
            if not has_letter(texts[i].as_py()):
                answer[i], score[i] = UNKNOWN, 0.0
        return answer, score

    @staticmethod
    def _doubtful(texts: pa.Array, sizes: np.ndarray) -> list[int]:
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False)
        return np.flatnonzero(~plain & (sizes > 0)).tolist()


def sample_features(rows: DataFrame, label: str, per_label: int, in_all: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Trigram counts of at most ``per_label`` rows of a label and ``in_all`` rows, picked by a hash of the id."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return []
    quota = max(min(per_label, in_all // len(counts)), 1)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * quota / n + 20 / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashed, offsets = trigrams(texts_of(batch.column("text")))
        pairs = [np.unique(hashed[a:b], return_counts=True) for a, b in zip(offsets, offsets[1:], strict=False)]
        found = [pa.array([x[k].astype(np.int32) for x in pairs], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("label"), *found], ["label", "gram", "n"])

    picked = rows.filter(chance < share[F.col(label)]).select(F.col(label).alias("label"), "text")
    taken: dict[str, int] = {}
    out = []
    for label_, gram, n in picked.mapInArrow(in_slices(features, size=SLICE), "label string, gram array<int>, n array<int>").toLocalIterator():
        if len(gram) and taken.get(label_, 0) < quota:
            taken[label_] = taken.get(label_, 0) + 1
            out.append((label_, np.array(gram, np.int32), np.array(n, np.float32)))
    return out


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = SAMPLE) -> Model:
    """Fit on rows with ``doc_id``, ``text`` and a non-null ``lang``."""
    sample = sample_features(only(rows, "doc_id", "text", "lang").filter("lang IS NOT NULL"), "lang", per_language, in_all)
    languages = sorted({x[0] for x in sample})
    families = sorted({family_of(x) for x in languages})
    lang = np.array([s[0] for s in sample], object)
    kin = np.array([family_of(s) for s in lang], object)
    # One matrix with a constant column; nothing below copies it.
    x = np.zeros((len(sample), (1 << BITS) + 1), np.float32)
    x[:, -1] = 1
    for i, (_, gram, n) in enumerate(sample):
        x[i, gram] = n / n.sum()
    mean = x.mean(axis=0, dtype=float) if len(sample) else np.zeros(x.shape[1])
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=float) / max(len(sample), 1) - mean**2, 0))
    scale = (1 / (spread + 1e-4) / np.sqrt(1 << BITS)).astype(np.float32)
    scale[-1] = 1
    x *= scale
    everyone = np.arange(len(sample))
    tasks = [((f,), everyone, kin == f) for f in families if len(families) > 1]
    for f in families:
        for a, b in combinations([v for v in languages if family_of(v) == f], 2):
            tasks.append(((a, b), np.flatnonzero((lang == a) | (lang == b)), lang == a))
    weights, bias = np.zeros((1 << BITS, len(tasks))), np.zeros(len(tasks))
    for c, (_, rows_, positive) in enumerate(tasks):
        w = svm.train(x, np.where(positive, 1.0, -1.0), only=rows_) * scale
        weights[:, c], bias[c] = w[:-1], w[-1]
    return Model(languages, families, [t[0] for t in tasks], weights, bias)


def identify(docs: DataFrame, model: Model, keep: list[Column] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the whole text, next to the columns ``keep`` (default: all)."""
    rows = docs.select(*(keep or [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(text):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([texts_of(pa.Array.from_pandas(text, type=pa.string()))], ["text"])
        parts = [shared.value.predict(part.column("text")) for part in slices(iter([batch]), size=SLICE)]
        return pd.DataFrame({"lang_pred": np.concatenate([p[0] for p in parts]), "score": np.concatenate([p[1] for p in parts])})

    names = [c for c in rows.columns]
    return rows.withColumn("__said", predict("text")).select(*[F.col(f"`{c}`") for c in names], "__said.lang_pred", "__said.score")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language was recognised, learned from those that name theirs; columns stay as they are.

    A language is said of every text with a letter, however unlike all of them it is, so only texts without letters go
    (and all, if nothing was learned).
    """
    names = docs.columns
    said = identify(docs.withColumn("__own", F.struct(*[F.col(f"`{c}`") for c in names])), learn(training(docs)), [F.col("text"), F.col("__own")])
    return said.filter(F.col("lang_pred") != UNKNOWN).select("__own.*")


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(id_bucket(4) != 2)


def op3_hierarchical_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(documents(spark, sf_dir), "doc_id", "text", "lang")
    said = identify(docs.drop("lang"), learn(training(docs)))
    return said.select("doc_id", F.coalesce(id_bucket(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
