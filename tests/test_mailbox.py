"""A Maildir and an mbox file as streams: offsets by UID and folder, the first run's limit, restarts, both phases."""

import mailbox

import pytest
from pyspark.sql import functions as F

from quire.sources import mailbox as B


def put(folder, uid, flags="", part="cur", text="x"):
    (folder / part).mkdir(parents=True, exist_ok=True)
    (folder / "new").mkdir(exist_ok=True)
    (folder / part / f"17000.M1P2,U={uid}:2,{flags}").write_bytes(f"From: a{uid}@x\nSubject: s\n\n{text} {uid}".encode())


def read(spark, path, folder, **options):
    """What a run until the end of the mailbox adds."""
    seen = []
    query = B.stream(spark, str(path), **options).writeStream.foreachBatch(lambda rows, _: seen.extend(rows.collect())).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(200)
    return sorted((r.folder, r.uid, bytes(r.content)) for r in seen)


def test_maildir_by_uid(spark, tmp_path):
    box = tmp_path / "box"
    for uid in (3, 7, 11, 12):
        put(box, uid, part="new" if uid == 12 else "cur")
    put(box / ".Ofertas", 5)
    (box / "cur" / "nothing").write_text("no number")
    got = read(spark, box, tmp_path / "c", first=2)
    assert [(f, u) for f, u, _ in got] == [("INBOX", 11), ("INBOX", 12), ("Ofertas", 5)] and got[0][2] == b"From: a11@x\nSubject: s\n\nx 11"
    assert read(spark, box, tmp_path / "c", first=2) == []
    put(box, 13)
    put(box / ".Nueva", 2)
    (box / "cur" / "17000.M1P2,U=3:2,").unlink()
    assert [(f, u) for f, u, _ in read(spark, box, tmp_path / "c", first=2)] == [("INBOX", 13), ("Nueva", 2)]
    put(box, 4)  # behind the offset: it was moved here
    put(box, 20, flags="S")
    assert [(f, u) for f, u, _ in read(spark, box, tmp_path / "c", first=2)] == [("INBOX", 20)]


def test_headers_first_then_bodies(spark, tmp_path):
    box = tmp_path / "box"
    for uid in range(1, 4):
        put(box, uid, text="long " * 5_000)
    headers = read(spark, box, tmp_path / "c", phase="header")
    assert [c for _, _, c in headers] == [f"From: a{u}@x\nSubject: s\n\n".encode() for u in (1, 2, 3)]
    wanted = spark.createDataFrame([(str(box / "cur" / "17000.M1P2,U=2:2,"), 2), (str(box / "cur" / "gone"), 9)], "path string, uid long")
    bodies = {r.uid: r.m for r in wanted.select("uid", B.whole_mail(F.col("path"), F.col("uid")).alias("m")).collect()}
    assert bodies[9] is None and bytes(bodies[2]).endswith(b"long  2")


def test_mbox(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "m"))
    for k in range(3):
        box.add(f"From: a{k}@x\n\nbody {k}\n".encode())
    box.flush()
    assert [(u, c.split()[-1]) for _, u, c in read(spark, tmp_path / "m", tmp_path / "c", first=2)] == [(2, b"1"), (3, b"2")]
    box.add(b"From: new@x\n\nbody new\n")
    box.flush()
    assert [(u, c.split()[-1]) for _, u, c in read(spark, tmp_path / "m", tmp_path / "c", first=2)] == [(4, b"new")]


def test_errors_are_tried_again():
    calls = []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("away")
        return "there"

    assert B.again(shaky, 3, 0.0) == "there" and len(calls) == 3
    with pytest.raises(OSError):
        B.again(lambda: (_ for _ in ()).throw(OSError("away")), 1, 0.0)
