"""The registered queries and the pipeline over the smallest tables."""

import collections

import pytest

import corpus_pipeline
from marquee.llm import decontamination, secrets
from marquee.llm.queries import ORACLES, QUERIES
from marquee.session import cut
from tests.compare import compare, connect
from tests.llm.helpers import CLASHING, SF, linked_components, table
from tests.llm.test_operators import ITEMS, LEAKS, SECRETS, plain_hits

COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3": "doc_id held_out lang_pred score", "op4": "page_id url text n_chars", "op5": "doc_id n_shingles component_id",
    "op6": "doc_id held_out n_tokens n_known train_tokens base_score score", "op7": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans", "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10": "doc_id held_out score predicted", "op11": "doc_id n_bytes n_tokens over_limit", "op12": "item_id rank doc_id score", "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op2": "doc_id slot shard shard_without_last",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        got, want = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
        assert got == want
    else:
        frame = QUERIES[name](spark, SF)
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(frame.columns)
        key = frame.columns[0]
        source = "pages" if key == "page_id" else "documents"
        assert {r[0] for r in frame.select(key).distinct().collect()} == {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()}


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline(spark, tmp_path):
    rows = [(i, t) for i, t in SECRETS if i is not None] + [(200 + i, t) for i, t in LEAKS if i is not None]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, rows)
    held, kept = [docs], []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)))
        held.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", *CLASHING], name
            kept.append(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    letters = sorted((i, t) for i, t in rows if any(map(str.isalpha, t or "")))
    assert kept[0] == letters
    same = linked_components({i: t for i, t in letters})
    twice = collections.Counter(i for i, _ in letters)
    single = sorted({(i, t) for i, t in letters if same[i] == i or twice[i] > 1})
    assert kept[1] == single
    clean = [(i, t) for i, t in single if not plain_hits(t, ITEMS)[1]]
    assert kept[2] == clean
    scan = secrets.scanner(secrets.RULES)
    assert {i for i, _ in kept[3]} == {i for i, _ in clean}
    assert [x for x in kept[3] if x in clean] == [x for x in clean if not scan(x[1])] and all(not secrets.scanner(secrets.RULES)(t) for _, t in kept[3])
    assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in clean}
    assert decontamination.WINDOW == 10


def test_pipeline_drops_near_copies(spark, tmp_path):
    """A copy with a tail appended shares some 0.86 of its five-word shingles."""
    words = [f"word{k}" for k in range(200)]
    texts = {1: words, 2: [*words, *[f"tail{k}" for k in range(30)]], 3: [f"other{k}" for k in range(200)]}
    assert linked_components({i: " ".join(t) for i, t in texts.items()}, 5, 80) == {1: 1, 2: 1, 3: 3}
    docs = table(spark, [(i, " ".join(t)) for i, t in texts.items()])
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, str(tmp_path)).collect()) == [1, 3]
