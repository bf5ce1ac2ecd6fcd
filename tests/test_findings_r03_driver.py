"""What the driver holds while a model is fitted (the check of round 3)."""

import random
import tracemalloc

from weftline.llm import toxicity as tx


def test_fit_keeps_the_words_of_the_sample_off_the_driver(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(20_000)]
    rows = [(i, " ".join(rng.choices(vocab, k=1_000)) + (" scum." if i % 3 == 0 else "."), int(i % 3 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    del rows
    tracemalloc.start()
    try:
        model = tx.fit(labelled)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.keys) == 2_048
    assert peak < 12_000_000  # 400,000 words have 1.2 M features
