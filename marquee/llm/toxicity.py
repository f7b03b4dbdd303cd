"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are compared by the subsequences of three characters that they share. A
subsequence may skip up to two characters, each skip halves its weight, so a word with
an inserted character ("idxiot") or a new ending keeps part of the likeness: cubed, a
fifth to a third in short words. The machine is therefore shown disguises, too: the
insults it found in a ``SHARE`` of the toxic documents with a symbol put in at each place,
next to the clean words that are most like them. Replaced characters are mostly missed.
Punctuation inside a word is removed before. The kernel of a sentence and a landmark word is the sum, over the words
of the sentence, of the cubed normalised word kernel. Landmarks are words of the
training sample: those that speak most for toxic documents, unlike each other, and
common ones. Kernel values against them, whitened by the landmarks' own kernel, are
the features of a linear support vector machine trained on sentences, which carry
the label of their document. Both classes weigh as in the labels, toxic sentences
twice that. The machine's value of a sentence is a sum over its words; a document
counts as its worst word, so that length alone makes no document worse, and a
logistic curve fitted on documents turns that into a score.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or after ``WORDS``
words. Four or more single letters in a row are read as one word.

The machine is fitted on a bounded sample: about ``DOCUMENTS`` of either class, and
at most ``SENTENCES`` of their sentences in all. All documents are scored whole.

Edge cases: null and empty texts score as a word unlike all landmarks; documents
labelled twice count as toxic if either label says so; without labels, or with one
class only, every score is the share of toxic labels (0 without any); repeated rows
get a row each; an empty table gives no rows.
"""

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import svm
from marquee.llm.common import documents, id_bucket, in_slices, only, sums, texts_of, word_lists

#: Bounds of the training sample.
DOCUMENTS, SENTENCES = 2000, 24_000
LANDMARKS, COMMON, WORDS = 128, 16, 32
#: Weight of a toxic sentence against its share in the labels.
WEIGHT = 2.0
THRESHOLD = 0.3
#: Most insults of which the machine is shown disguises, the symbols put in, and clean words shown next to them.
INSULTS, SYMBOLS, CLEAN = 64, list(string.ascii_lowercase + "1"), 2000
#: Share of the toxic documents that such an insult is in at least, and the weight of these single words against a sentence.
SHARE, SINGLE = 0.05, 5.0
#: Weight of all disguises together in the curve, against that of the toxic documents.
DISGUISED = 0.2
DECAY, POWER = 0.5, 3
#: Word scores that a task remembers; when there are more it starts over.
REMEMBERED = 300_000
#: Distances of the second and third character from the first, with the weight of the skips.
STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, 5) for a in range(1, b)]


def symbols() -> np.ndarray:
    """1 to 26 for letters, 31 for other ASCII, 0 for the mark at a word's ends."""
    table = np.full(128, 31, np.uint32)
    table[97:123] = np.arange(1, 27)
    table[0] = 0
    return table


TABLE = symbols()
MARKS = dict.fromkeys(map(ord, string.punctuation))


def normal(word: str) -> str:
    """A word in lower case without punctuation, also between its letters."""
    return word.lower().translate(MARKS)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of five symbols (rows; 32 beyond a word's end), the run at every
    character of the words one after the other, and where each word starts."""
    line = "".join([f"\0{w}\0" for w in words])
    point = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = np.where(point < 128, TABLE[np.minimum(point, 127)], 27 + point % 4).astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(sym))
    padded = np.append(sym, [0] * 4)
    code = sum(np.where(left > k, padded[k : k + len(sym)], 32) << 6 * k for k in range(5))
    runs, at = np.unique(code, return_inverse=True)
    return np.column_stack([runs >> 6 * k & 63 for k in range(5)]), at, np.cumsum(lengths) - lengths


def subsequences(runs: np.ndarray):
    """For each pair of steps: the runs that are long enough, the codes of their subsequences, and the weight."""
    for a, b, weight in STEPS:
        rows = np.flatnonzero(runs[:, b] != 32)
        yield rows, runs[rows, 0] << 10 | runs[rows, a] << 5 | runs[rows, b], weight


def norms(runs: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    squares = np.zeros(len(runs))
    for rows, _, weight in subsequences(runs):
        squares[rows] += weight**2
    return np.sqrt(np.add.reduceat(squares[at], starts)) + 1e-9


def word_sums(of_run: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``of_run[at]`` by word: all first rows, all second rows, and so on."""
    matter = of_run.any(axis=1)[at]
    kept = np.concatenate([[0], np.cumsum(matter)])
    begin, sizes = kept[starts], np.diff(kept[np.append(starts, len(at))])
    at, order = at[matter], np.argsort(-sizes, kind="stable")
    begin, sizes = begin[order], sizes[order]
    total = np.zeros((len(starts), of_run.shape[1]), np.float32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))
        total[:n] += of_run[at[begin[:n] + k]]
    out = np.empty_like(total)
    out[order] = total
    return out


def against(words: list[str], table: np.ndarray) -> np.ndarray:
    """Cubed kernel values of words (rows) with the landmarks (columns of ``table``).

    A word's value is a sum over its runs, and words share most of their runs.
    """
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for first in range(0, len(words), 32768):
        runs, at, starts = windows(words[first : first + 32768])
        of_run = np.zeros((len(runs), table.shape[1]), np.float32)
        for rows, codes, weight in subsequences(runs):
            of_run[rows] += table[codes] * np.float32(weight)
        out[first : first + len(starts)] = (word_sums(of_run, at, starts) / norms(runs, at, starts)[:, None].astype(np.float32)) ** POWER
    return out


def landmark_table(words: list[str]) -> np.ndarray:
    """Weights of all subsequences (rows) in each landmark (columns), over the landmark's norm."""
    table = np.zeros((1 << 15, len(words)), np.float32)
    if words:
        runs, at, starts = windows(words)
        size = norms(runs, at, starts)
        for rows, codes, weight in subsequences(runs):
            code = np.full(len(runs), -1)
            code[rows] = codes
            here, owner = code[at], np.searchsorted(starts, np.arange(len(at)), side="right") - 1
            np.add.at(table, (here[here >= 0], owner[here >= 0]), weight / size[owner[here >= 0]])
    return table


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Sentences of the texts: number of the first sentence of each text, first word of each
    sentence, and all words as positions in a list of distinct normalised ones.

    Every text has at least one sentence, be it without words.
    """
    offsets, words = word_lists(texts)
    single = (pc.utf8_length(words).to_numpy(zero_copy_only=False) == 1).astype(np.int8)
    coded = words.dictionary_encode()
    token = coded.indices.to_numpy().astype(np.int64)
    raw = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ends = pc.match_substring_regex(coded.dictionary, r"[.!?][\"')\]]*$").to_numpy(zero_copy_only=False).astype(bool)[token] if len(token) else np.zeros(0, bool)
    n = len(token)
    # Runs of single letters: their first word becomes the run, the others become empty.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
    spelled = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= 4:
            spelled[a, b] = "".join(raw[token[k]] for k in range(a, b) if raw[token[k]].isalpha())
    names = [normal(w) for w in raw]
    for (a, b), whole in spelled.items():
        names += [whole.lower(), ""]
        token[a], token[a + 1 : b] = len(names) - 2, len(names) - 1
    distinct = {w: k for k, w in enumerate(dict.fromkeys(names))}
    token = np.array([distinct[w] for w in names], np.int64)[token] if n else token
    start = np.zeros(n + 1, bool)
    start[offsets[:-1]] = True
    start[1:] |= np.concatenate([ends, [False]])[:-1] if n else False
    run = np.maximum.accumulate(np.where(start[:n], np.arange(n), 0)) if n else np.zeros(0, np.int64)
    start[:n] |= (np.arange(n) - run) % WORDS == 0
    first = np.flatnonzero(start[:n])
    # A text without words gets a sentence that is empty.
    empty = np.flatnonzero(np.diff(offsets) == 0)
    place = np.searchsorted(first, offsets[empty])
    first = np.insert(first, place, offsets[empty])
    text_first = np.searchsorted(first, offsets[:-1], side="left") if not len(empty) else None
    if text_first is None:
        counts = np.diff(np.searchsorted(np.flatnonzero(start[:n]), offsets))
        counts[empty] = 1
        text_first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return text_first, np.append(first, n), token, list(distinct)


@dataclass
class Model:
    """Landmarks with their weights, and the curve from sentence values to scores."""

    table: np.ndarray
    beta: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    #: If not None, the score of every document.
    share: float | None = None
    memory: dict[str, float] = field(default_factory=dict)

    def worst(self, texts: pa.Array) -> np.ndarray:
        """The value of each text's worst word."""
        text_first, first, token, words = sentences(texts)
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = [w for w in words if w not in self.memory]
        if new:
            self.memory.update(zip(new, (against(new, self.table) @ self.beta).tolist(), strict=True))
        value = np.array([self.memory[w] for w in words])
        starts = np.append(first[text_first], len(token))
        worst, full = np.zeros(len(texts)), np.flatnonzero(np.diff(starts))
        if len(full):
            worst[full] = np.maximum.reduceat(value[token], starts[full])
        return worst + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.offset, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, size: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``size`` documents of either label, by a hash of their id; and how many there are of each."""
    marked = only(labels, "doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(id_bucket(4) != 2)
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, size / counts.get(1, 1))).otherwise(min(1.0, size / counts.get(0, 1)))
    # At most a few thousand ids, whatever the tables' size.
    picked = F.broadcast(marked.filter(chance < share))
    return only(docs, "doc_id", "text").join(picked, "doc_id"), counts


def learn(docs: DataFrame, labels: DataFrame, size: int = DOCUMENTS, most: int = SENTENCES) -> Model:
    sample, counts = training_sample(docs, labels, size)
    nothing = Model(np.zeros((1 << 15, 0), np.float32), np.zeros(0), 0.0)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        nothing.share = float(counts.get(1, 0) > 0)
        return nothing
    found = sample_sentences(sample, size, most)
    if len({t for _, t, _ in found}) < 2:
        nothing.share = counts[1] / (counts[0] + counts[1])
        return nothing
    marks = choose_landmarks(found)
    table = landmark_table(marks)
    own = against(marks, table).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    # Sampled documents of a label stand for all of it.
    drawn = [len({d for d, t, _ in found if t == label}) for label in (0, 1)]
    scarce = counts[0] / drawn[0] / (counts[1] / drawn[1])
    model = fit(found, table, whiten, scarce)
    insults = insults_of(found, model)
    disguised = disguises(insults)
    if disguised:
        shown = [(0, 1, [w]) for w in disguised] + [(0, 0, [w]) for w in clean_words(found, insults)]
        model = fit(found + shown, table, whiten, scarce, len(found))
    calibrate(model, sample, counts, disguised)
    return model


def fit(found: list[tuple[int, int, list[str]]], table: np.ndarray, whiten: np.ndarray, scarce: float, plain: int | None = None) -> Model:
    """The machine for these sentences, with its weights on the landmarks; those from ``plain`` on are single words and weigh ``SINGLE`` times as much."""
    toxic = np.array([t for _, t, _ in found])
    words = list(dict.fromkeys(w for _, _, s in found for w in s))
    place = {w: k for k, w in enumerate(words)}
    kernel = against(words, table)
    rows = np.zeros((len(found), whiten.shape[1]))
    for first in range(0, len(found), 500):
        part = [s for _, _, s in found[first : first + 500]]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in part])])
        rows[first : first + len(part)] = sums(kernel[[place[w] for s in part for w in s]], offsets) @ whiten
    cost = np.where(toxic == 1, WEIGHT, scarce)
    cost[plain if plain is not None else len(found) :] *= SINGLE
    w = svm.train(np.column_stack([rows, np.ones(len(rows))]), np.where(toxic == 1, 1.0, -1.0), cost, rounds=25)
    return Model(table, whiten @ w[:-1], float(w[-1]))


def insults_of(found: list[tuple[int, int, list[str]]], model: Model) -> list[str]:
    """Words of a ``SHARE`` of the toxic documents and no clean sentence that the machine takes for toxic by themselves."""
    clean = {w for _, toxic, words in found if not toxic for w in words}
    homes: dict[str, set[int]] = {}
    for doc, toxic, words in found:
        for w in words if toxic else []:
            if len(w) > 3 and w not in clean:
                homes.setdefault(w, set()).add(doc)
    least = max(2, SHARE * len({doc for doc, toxic, _ in found if toxic}))
    words = sorted(w for w, docs in homes.items() if len(docs) >= least)
    value = against(words, model.table) @ model.beta + model.bias
    return sorted((words[k] for k in np.flatnonzero(value > 0)), key=lambda w: (-len(homes[w]), w))[:INSULTS]


def disguises(insults: list[str]) -> list[str]:
    """The insults with a symbol put in at each place between their own, some different ones each."""
    rng = np.random.default_rng(13)
    return [w[:k] + x + w[k:] for w in insults for k in range(1, len(w)) for x in rng.choice(SYMBOLS, 4, replace=False)]


def clean_words(found: list[tuple[int, int, list[str]]], insults: list[str]) -> list[str]:
    """The words of clean sentences that are most like an insult: what disguises have to be told from."""
    words = sorted({w for _, toxic, words in found if not toxic for w in words})
    likeness = against(words, landmark_table(insults)).max(axis=1) if words else np.zeros(0)
    return [words[k] for k in np.argsort(-likeness, kind="stable")[:CLEAN]]


def sample_sentences(sample: DataFrame, size: int, most: int) -> list[tuple[int, int, list[str]]]:
    """(document, label, words) of at most ``most`` sentences, spread evenly over the documents."""
    each = max(most // (2 * size), 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text_first, first, token, words = sentences(texts_of(batch.column("text")))
        last = np.append(text_first[1:], len(first) - 1)
        out = []
        for row, (a, b) in enumerate(zip(text_first, last, strict=True)):
            # Every sentence of a short document; of a long one, some at equal distances.
            for k in np.unique(np.linspace(a, b - 1, min(each, b - a)).astype(int)):
                out.append((row, sorted({words[w] for w in token[first[k] : first[k + 1]]} - {""})))
        index = pa.array([r for r, _ in out], pa.int32())
        columns = [batch.column("doc_id").take(index).cast(pa.int64()), batch.column("toxic").take(index).cast(pa.int32()), pa.array([s for _, s in out], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "words"])

    return [tuple(r) for r in sample.mapInArrow(in_slices(run), "doc_id long, toxic int, words array<string>").collect()]


def choose_landmarks(found: list[tuple[int, int, list[str]]]) -> list[str]:
    """Words that speak for label 1 and are unlike each other, then the most common ones."""
    seen = {0: {}, 1: {}}
    for doc, toxic, words in found:
        for w in words:
            if len(w) > 2:
                seen[toxic].setdefault(w, set()).add(doc)
    n = {t: len({d for d, x, _ in found if x == t}) for t in (0, 1)}
    hits = {w: len(d) for w, d in seen[1].items()}
    misses = {w: len(d) for w, d in seen[0].items()}
    gain = {w: k * np.log((k + 0.5) / n[1] / ((misses.get(w, 0) + 0.5) / n[0])) for w, k in hits.items() if k >= 2}
    ranked = sorted(gain, key=lambda w: (-gain[w], w))[: 3 * LANDMARKS]
    common = sorted(set(hits) | set(misses), key=lambda w: (-hits.get(w, 0) - misses.get(w, 0), w))[: 4 * COMMON]
    table = landmark_table(ranked + common) if ranked + common else np.zeros((1 << 15, 0))
    alike = table.T @ table
    chosen: list[int] = []
    for pool, most in ((range(len(ranked)), LANDMARKS - COMMON), (range(len(ranked), len(ranked) + len(common)), LANDMARKS)):
        for k in pool:
            if len(chosen) < most and all(alike[k, c] < 0.7 for c in chosen):
                chosen.append(k)
    return [(ranked + common)[k] for k in chosen] or ["\0"]


def calibrate(model: Model, sample: DataFrame, counts: dict[int, int], disguised: list[str]) -> None:
    """Fit the curve on the sampled documents, weighted to the real share of labels.

    The ``disguised`` insults weigh ``DISGUISED`` times as much as the toxic documents, all together.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(model.worst(texts_of(batch.column("text"))))], ["toxic", "worst"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(in_slices(run), "toxic int, worst double").collect()], float).reshape(-1, 2)
    drawn = np.bincount(rows[:, 0].astype(int), minlength=2)
    weight = np.array([counts[t] / max(drawn[t], 1) for t in (0, 1)])
    weight = weight / weight.max()
    weights = weight[rows[:, 0].astype(int)]
    if disguised:
        worst = against(disguised, model.table) @ model.beta + model.bias
        rows = np.concatenate([rows, np.column_stack([np.ones(len(worst)), worst])])
        weights = np.append(weights, np.full(len(worst), DISGUISED * weight[1] * drawn[1] / len(worst)))
    model.slope, model.offset = svm.platt(rows[:, 1], rows[:, 0], weights)
    model.memory.clear()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(texts_of(batch.column("text"))))], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(in_slices(run), "doc_id long, score double")


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(documents(spark, sf_dir), "doc_id", "text")
    scored = score_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(id_bucket(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
