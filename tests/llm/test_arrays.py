import numpy as np

from tracemill.llm import arrays


def test_arrays_are_mapped_or_held_up_to_a_bound(tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    for i in range(6):
        arrays.put(folder, f"x{i}", np.arange(100_000) + i)
    assert isinstance(arrays.get(folder, "x1"), np.memmap) and arrays.get(folder, "x1") is arrays.get(folder, "x1")
    arrays.close_others("")
    # a store that cannot be mapped, played by the same folder
    monkeypatch.setattr(arrays, "_local", lambda uri: None)
    monkeypatch.setattr(arrays, "HELD_BYTES", 2_000_000)
    uri = f"file://{folder}"
    for _ in range(2):
        for i in range(6):
            assert arrays.get(uri, f"x{i}")[5] == 5 + i
            assert sum(a.nbytes for a in arrays._open.values()) <= 2_000_000
    arrays.put(uri, "y", np.zeros(3))
    assert arrays.get(uri, "y").tolist() == [0, 0, 0]
    arrays.close_others("")
    assert not arrays._open
