"""Files of a slice become those of the next."""

import os

import pytest

from veilscan.sources import slices
from veilscan.sources.sinks import _open_file
from veilscan.sources.slices import FILE_BYTES, in_slices


@pytest.mark.parametrize("uri", ["file://", ""])
def test_slices_take_over_files(spark, tmp_path, monkeypatch, uri):
    monkeypatch.setattr(slices, "shared_folder", lambda _: f"{uri}{tmp_path}")
    rows = [(f"a{i % 7}/{i}.py", "x" * (i % 90) if i % 5 else None) for i in range(300)]
    rows += [(f"a1/long{i}.py", "y" * 9000 * (1 + i % 2)) for i in range(20)] + rows[:9]
    seen, inodes = [], []

    def use(top, scratch):
        place = top.removeprefix("file://")
        found = [os.path.join(t, n) for t, _, names in os.walk(place) for n in names]
        everywhere = [n for t, _, names in os.walk(tmp_path) for n in names if n.endswith(".py")]
        assert len(found) == len(everywhere) and all(os.stat(f).st_nlink == 1 for f in found)
        seen.extend((os.path.relpath(f, place), open(f).read()) for f in found)
        inodes.append({os.stat(f).st_ino for f in found if os.path.getsize(f) < 5000})

    in_slices(spark.createDataFrame(rows, "path string, text string"), use, slice_bytes=90 * FILE_BYTES)
    assert sorted(seen) == sorted({(p, t or "") for p, t in rows})
    assert len(inodes) == 5 and not [n for n in os.listdir(tmp_path) if n.startswith("slices-")]
    for before, after in zip(inodes, inodes[1:]):
        assert len(before & after) >= 0.9 * min(len(before), len(after))


def written(place, spent, data):
    with os.fdopen(_open_file(str(place), iter([str(s) for s in spent])), "wb") as file:
        file.write(data)
        file.truncate()
    return open(place, "rb").read()


def test_a_file_with_another_name_is_not_written(tmp_path):
    new, old, other = (tmp_path / n for n in ("new", "old", "other"))
    old.write_bytes(b"a longer text than the new one")
    assert written(new, [old], b"short") == b"short" and not old.exists()
    other.write_bytes(b"of another attempt")
    os.link(other, old)  # as an attempt leaves it that broke off between its two steps
    assert written(tmp_path / "third", [old], b"third") == b"third"
    assert other.read_bytes() == b"of another attempt" and not old.exists()
    os.link(other, tmp_path / "fourth")
    assert written(tmp_path / "fourth", [], b"") == b"" and other.read_bytes() == b"of another attempt"
    assert written(tmp_path / "fifth", [tmp_path / "gone"], b"5") == b"5"
