import os
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from vdomain.llm import common


def test_scratch_tables_go(spark):
    s = common.Scratch(spark, "t")
    a, b = s.table(spark.range(3)), s.table(spark.range(4))
    c = s.table(spark.range(5), a)
    assert not os.path.exists(a._scratch_path) and b.count() == 4
    s.only(c)
    assert not os.path.exists(b._scratch_path) and c.count() == 5
    s.drop()
    assert not os.path.exists(s.base)


def test_a_stage_drops_what_its_predecessors_left(spark, tmp_path):
    with common.stage(spark.range(1)):
        s = common.Scratch(spark, "one")
        lazy = s.table(spark.range(3))
    with common.stage(lazy):  # reads what the first stage left
        t = common.Scratch(spark, "two")
        t.table(spark.range(3))
    assert lazy.count() == 3
    lazy.write.parquet(str(tmp_path / "out"))
    with common.stage(spark.read.parquet(str(tmp_path / "out"))):
        pass
    assert not os.path.exists(s.base) and not os.path.exists(t.base)


def anonymous_mb(pid):
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
@pytest.mark.parametrize("how", ["long write", "stage"])
def test_freed_memory_of_the_driver_goes_back_to_the_system(spark, monkeypatch, tmp_path, how):
    jvm = spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid = field.get(None), int(jvm.java.lang.ProcessHandle.current().pid())
    chunks = [unsafe.allocateMemory(60_000) for _ in range(3000)]
    for c in chunks:
        unsafe.setMemory(c, 60_000, 1)
    held = [c for k, c in enumerate(chunks) if k % 50 == 0 or k == len(chunks) - 1]  # so that none of the rest goes by itself
    for c in set(chunks) - set(held):
        unsafe.freeMemory(c)
    before = anonymous_mb(pid)
    if how == "stage":
        with common.stage(spark.range(1)):
            pass
    else:
        monkeypatch.setattr(common, "PROMPT", -1.0)
        s = common.Scratch(spark, "t")
        s.table(spark.range(3))
        s.drop()
    after = anonymous_mb(pid)
    for c in held:
        unsafe.freeMemory(c)
    assert after < before - 100


def test_trimming_is_left_out_where_it_is_not_offered(spark, monkeypatch):
    class C:
        def __init__(self, name):
            pass

    monkeypatch.setattr(common.ctypes, "CDLL", C)
    real = spark.sparkContext._gateway.new_array
    monkeypatch.setattr(spark.sparkContext._gateway, "new_array", lambda kind, n: real(kind, 1 + n))  # the JVM refuses five arguments
    common.trim(spark)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_whole_groups(rows):
    keys = np.sort(np.random.default_rng(1).integers(0, 9, 100))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 13]), pa.array(np.arange(lo, min(lo + 13, 100)))], ["k", "v"]) for lo in range(0, 100, 13)]
    seen, values = [], []
    for t, starts in common.whole_groups(iter(batches), "k", rows=rows):
        k = t.column("k").to_numpy()
        for lo, hi in zip(starts, starts[1:]):
            assert (k[lo:hi] == k[lo]).all()
            seen.append(k[lo])
        values += t.column("v").to_pylist()
    assert seen == sorted(set(keys.tolist())) and values == list(range(100))
