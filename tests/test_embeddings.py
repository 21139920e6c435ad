import numpy as np
from pyspark.sql import functions as F

from recollect.operators import vector


def test_hashed_embedding_equals_one_word_at_a_time(spark):
    texts = ["One two  two three Two!", "é ß x-y 12", "", None, "??", "again " * 400 + "and " * 300]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", vector.hashed_embedding(F.col("t"), 16).alias("e")).collect()
    words = [["one", "two", "two", "three", "two"], ["é", "ß", "x", "y", "12"], [], [], [], ["again"] * 400 + ["and"] * 300]
    for r in got:
        v = np.zeros(16, np.float32)
        for i, w in enumerate(words[r.id]):
            h = 0xCBF29CE484222325
            for byte in w.encode():
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            v[h % 16] += np.float32((-1.0 if h >> 63 else 1.0) / np.sqrt(i + 1))
        norm = float(np.sqrt((v.astype(float) ** 2).sum()))
        assert r.e == (v / np.float32(norm) if norm else v).tolist()
