"""Archives are dealt to tasks as parts of their indexes, however many members they have."""

import io
import pickle
import tarfile
import zipfile
from pathlib import Path

import pytest

from assayspark.functions.one_document import holds, rows_of
from assayspark.sources import assaytab as A
from tests.test_filled import _JSON
from tests.test_located import _TEXTS

NAMES = [*(f"m{i}.txt" for i in range(3000)), "ünï.txt", "deep/er/x.txt", "long" * 60 + ".txt"]


def _zip(path, front=b"", comment=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for i, name in enumerate(NAMES):
            if i % 500 == 0:
                archive.mkdir(f"folder{i}")
            with archive.open(zipfile.ZipInfo(name), "w", force_zip64=i % 7 == 0) as member:
                member.write(f"text {name}".encode() * (i % 5))
        archive.comment = comment
    Path(path).write_bytes(front + held.getvalue())


def _tar(path, **options):
    with tarfile.open(path, "w", **options) as archive:
        for i, name in enumerate(NAMES):
            if i % 500 == 0:
                folder = tarfile.TarInfo(f"folder{i}")
                folder.type = tarfile.DIRTYPE
                archive.addfile(folder)
            info, data = tarfile.TarInfo(name), f"text {name}".encode() * (i % 5)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("kind", ["zip", "zip behind other bytes", "zip with a comment", "tar", "tar with headers of its own", "gnu tar"])
def test_parts(tmp_path, kind):
    path = f"{tmp_path}/all.{'zip' if kind.startswith('zip') else 'tar'}"
    if "zip" in kind:
        _zip(path, b"what stands in front" if "behind" in kind else b"", b"a comment" * 20 if "comment" in kind else b"")
    else:
        _tar(path, format=tarfile.GNU_FORMAT if "gnu" in kind else tarfile.PAX_FORMAT, **({"pax_headers": {"comment": "x"}} if "own" in kind else {}))
    want = [(f"{path}/{name}", f"text {name}".encode() * (i % 5)) for i, name in enumerate(NAMES)]
    for most in (0, 30_000, 100_000):
        groups = A.dealt(A.units_of(path, most), 100_000)
        assert len(groups) > 5 and [x for g in groups for x in A.contents(g)] == want
    few, many = (len(pickle.dumps(A.Reader({"path": path, "partitionbytes": most}, "documents", None).partitions())) for most in (4_000_000, 100_000))
    assert few < 2000 and many < 300 * (len(groups) + 2)  # not in proportion to the members
    assert [u.name for x in A.Reader({"path": path, "file_id": f"{path}/ünï.txt"}, "items", None).partitions() for u in x.units] == [f"{path}/ünï.txt"]
    one = A.FilteredReader({"path": path}, "documents", None)
    assert list(one.pushFilters([A.EqualTo(("file_id",), f"{path}/deep/er/x.txt")])) == [] and [n for p in one.partitions() for n, _ in A.contents(p.units)] == [f"{path}/deep/er/x.txt"]


def test_no_archive(tmp_path):
    Path(tmp_path, "a.zip").write_bytes(b"PK" * 100)
    with pytest.raises(zipfile.BadZipFile):
        list(A.units_of(f"{tmp_path}/a.zip"))


def test_documents_with_an_item(spark, tmp_path):
    spark.dataSource.register(A.AssayTab)
    texts = {f"{k}.txt": v for k, v in _TEXTS.items()} | {"j.txt": _JSON, "none.txt": "what"}
    spark.createDataFrame(list(texts.items()), "name string, text string").write.format("assaytab").option("archive", "zip").mode("overwrite").save(f"{tmp_path}/all.zip")
    read = lambda **options: sorted(map(repr, spark.read.format("assaytab").options(**options).load(f"{tmp_path}/all.zip").collect()))
    having = {k for k, v in texts.items() if ("MS", "MS_TYPE", "ESI") in [(s, key, value) for s, _, key, value, *_ in rows_of(v, "items")]}
    assert {"j.txt"} < having < set(texts)
    for table in ("values", "items", "documents"):
        assert read(table=table, where="MS:MS_TYPE=ESI") == [r for r in read(table=table) if any(f"/{k}'" in r for k in having)]
    assert read(table="cells", where="SU:SUBJECT_TYPE=x=y") == [] and not holds('{"MS": 1}', "MS", "MS_TYPE", "ESI")
    with pytest.raises(ValueError, match="no condition"):
        A.Reader({"path": "x", "where": "MS_TYPE=ESI"}, "items", None)
