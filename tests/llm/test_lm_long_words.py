import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from planarlake.llm import lm as L


def test_words_have_no_floor():
    words, size = np.array([0, 1, 2]), np.array([3])
    steps = L.Steps(words, size, np.zeros(3, np.int64), np.arange(3, dtype=np.uint64), 0)
    got = L.word_logs(steps, L.Chooser(), words, np.array([-30.0, -5000.0, -9000.0]), 0)
    assert -5002 < got[1] < -4999.9 and -9002 < got[2] < -8999.9


def test_long_unknown_words_cost_their_length(spark):
    from planarlake.llm import common as C

    rnd = random.Random(2)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    seen = [(i, " ".join(rnd.choice(["the", "cat", "dog", "sat", f"w{i}"]) for _ in range(30))) for i in range(100) if i not in held]
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8000))
    df = spark.createDataFrame([*seen, (held[0], long[:4000]), (held[1], long)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.lm_scores(df, C.crc_mod(F.col("doc_id"), 5)).collect()}
    assert got[held[0]].bits_per_byte > 4 and got[held[1]].bits_per_byte > 4
    assert got[held[1]].score < 1.8 * got[held[0]].score < -290
