"""Similar pairs of many sets: classes of equal sets, rounds of bounded meetings, and no shuffle files left."""

import random
from pathlib import Path
from urllib.parse import urlparse

from newsdesk.operators import similarity as S
from newsdesk.sources.scratch import stored


def test_pairs_of_classes_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    sets = {i: sorted(set(rng.choices("abcdefghijkl", k=rng.randint(1, 9)))) for i in range(120)}
    sets |= {i: sets[i % 7] for i in range(120, 160)}  # copies
    want = sorted((a, b, n) for a in sets for b in sets if a < b and (n := len(set(sets[a]) & set(sets[b]))) / min(len(sets[a]), len(sets[b])) >= 0.8)
    met = []
    monkeypatch.setattr(S, "MEETINGS", 1)
    monkeypatch.setattr(S, "VERIFIED", 1)
    monkeypatch.setattr(S, "dealt", lambda a, b, on, f=S.dealt: (on[0] == "token" and met.append(f(a, b, on).count())) or f(a, b, on))
    df = spark.createDataFrame(list(sets.items()), "k int, t array<string>")
    assert sorted((r.a, r.b, r.shared) for r in S.similar_pairs(df, "k", "t", 0.8).collect()) == want
    held = sum(map(len, {tuple(s) for s in sets.values()}))
    assert len(met) > 1 and max(met) <= 2 * 3 * held  # a share of the sets by hash


def test_no_shuffle_files_stay_when_a_table_is_stored(spark):
    def blocks() -> int:
        return sum(1 for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _ in Path(d).rglob("shuffle_*.data"))

    before = blocks()
    table = stored(spark.range(1000).repartition(4, "id"))
    assert blocks() <= before and table.count() == 1000 and Path(urlparse(table.stored_path).path).is_dir()
