"""Round 4: messages of large blocks take one step to their groups, as every hop writes them all to disk again."""

import numpy as np

from weftline.llm import _blocks as B
from weftline.llm.kneser_ney import model_scores


def test_large_blocks_send_directly_and_small_ones_in_hops(spark):
    long = spark.range(64).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text")
    layout = B.blocks(long, fan=2)
    assert layout.slices > 2 and layout.to_slices.width() == 1 and layout.to_blocks.width() == 1
    layout = B.blocks(long.selectExpr("doc_id", "left(text, 10) AS text"), fan=2)
    assert layout.to_slices.width() > 1 and layout.to_blocks.width() > 1


def test_op7_moves_its_messages_once(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefgh"), 4000))) for i in range(40)], "doc_id long, text string")
    hops = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("_sender")
    assert hops(model_scores(docs, fan=2)) == 0
    short = docs.selectExpr("doc_id", "left(text, 20) AS text")
    assert hops(model_scores(short, fan=2)) > 0


def test_a_group_gets_one_compressed_row():
    counts = np.ones(5000, np.uint64)
    rows = [(g, 7, kind, 5000, B.pack_counts(counts), None) for g in range(3) for kind in (1, 2)]
    sent = B.Route(0, 3).send(rows, 7)
    assert len(sent) == 3 and sent.nbytes < 3000
    assert B.read(sent) == sorted(rows, key=lambda r: (r[1], r[0], r[2]))
