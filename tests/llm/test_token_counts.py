"""Token counts against the tokenizer on whole texts."""

import random

import pyarrow as pa
import pytest

from marquee.llm import token_counts
from marquee.llm.queries import QUERIES
from tests.llm.helpers import ODD, SF, table

PARTS = [" ", " ", "  ", "▁", "a", "b", "the", "und", "\n", "\t", "é", "日", "\x00", "𝒳", "x" * 70, "1", "23", "<s>", "</s>", "<unk>", "<0x41>", ".", "é"]


def whole(texts):
    processor = token_counts.loaded(token_counts.TOKENIZER)
    return [len(processor.encode(t or "")) for t in texts]


def test_pre_tokens_make_up_the_text():
    texts = ["", " ", "a  b ", "▁a▁▁", "one two", " lead", "x"]
    offsets, units = token_counts.pre_tokens(pa.array(texts))
    units = units.to_pylist()
    got = ["".join(units[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [" " + t.replace("▁", " ") if t else "" for t in texts]
    assert all(u.startswith(" ") and " " not in u.lstrip(" ") for u in units)


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_whole_texts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(2000)]
    known = [" the", " a", " und"]
    counter = token_counts.Counter(known, token_counts.lengths_of(known, token_counts.loaded(token_counts.TOKENIZER)), token_counts.TOKENIZER)
    assert counter.counts(pa.array(texts)).tolist() == whole(texts)


def test_small_table_and_cache(spark, monkeypatch):
    """Neither what the table holds nor a cache that starts over changes a count."""
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "HELD", 2)
    texts = [t or "" for _, t in ODD]
    for units in ([], [" the"]):
        counter = token_counts.Counter(units, token_counts.lengths_of(units, token_counts.loaded(token_counts.TOKENIZER)), token_counts.TOKENIZER)
        for _ in range(2):
            assert counter.counts(pa.array(texts)).tolist() == whole(texts) and len(counter.cache) <= 1 + 3 + len(set(" ".join(texts).split(" ")))


def test_summaries_keep_what_is_frequent():
    keys, counts = token_counts.joined([pa.array(["a", "b", "c"]), pa.array(["a", "d", "e"])], [[50, 3, 2], [40, 2, 1]], 2)
    held = dict(zip(keys.to_pylist(), counts.tolist(), strict=True))
    assert held["a"] > 80 and len(held) <= 2 and all(n <= 90 for n in held.values())


def test_vocabulary_that_joins_words_is_refused():
    class Joining:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, k):
            return ["▁▁a", "of▁the"][k]

    with pytest.raises(ValueError, match="piece 1"):
        token_counts.check_pieces(Joining())


def test_odd_rows(spark):
    got = token_counts.token_counts(table(spark), limit=2).collect()
    want = [(i, len((t or "").encode()), n, n > 2) for (i, t), n in zip(ODD, whole([t for _, t in ODD]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(table(spark, [])).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), n, n > 4096) for r, n in zip(rows, whole([r["text"] for r in rows]), strict=True)}
    assert {tuple(r) for r in QUERIES["op11_token_counts"](spark, SF).collect()} == want
