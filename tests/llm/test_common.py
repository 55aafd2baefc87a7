from granary.llm import _common


def test_frugal_gives_back_when_a_task_ends_or_is_left(monkeypatch):
    given = []
    monkeypatch.setattr(_common, "give_back", lambda: given.append(1))
    run = _common.frugal(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2, 3]))) == [2, 4, 6] and given == [1]
    left = run(iter([1, 2, 3]))
    assert next(left) == 2 and given == [1]
    left.close()
    assert given == [1, 1]


def test_workers_return_freed_memory(spark):
    """Small objects that lie between others that stay are the C library's to keep, unless it is told to give them back."""
    import re
    from pathlib import Path

    import pyarrow as pa

    used = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    def run(batches):
        for _ in batches:
            before = used()
            held = [bytes(700) for _ in range(150_000)]
            last = bytes(700)
            del held
            _common.give_back()
            yield pa.RecordBatch.from_arrays([pa.array([used() - before - (len(last) > 700)])], ["mb"])

    assert max(r["mb"] for r in spark.range(1).mapInArrow(run, "mb long").collect()) < 30
