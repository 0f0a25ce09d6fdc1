"""A mailbox as a stream: a Maildir or an mbox file, read by UID.

Each folder has its own offset, the highest UID that was read, so a restart goes on behind it whatever became of older mails.  The first run starts `first`
mails (40) before the end of each folder.  A stream reads headers alone (phase `header`) or whole mails (phase `mail`); with the first, `whole_mail` fetches the bodies of
those that are wanted.

A Maildir is a folder with `cur` and `new`, its subfolders begin with a dot; a mail's UID is the number behind `U=` in its file's name, else the number that the
name begins with, and files without one are left out.  In an mbox file UIDs are places from 1.  A mail that goes while it is read is left out, other errors of the file system are tried
again (`retries`, with a pause that doubles).  All executors have to see the path.
"""

from __future__ import annotations

import mailbox
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quire.session import carry

carry(__name__)

SCHEMA = "folder string, uid long, path string, content binary"
FIRST, SHARE = 40, 200
_UIDS = re.compile(r",U=(\d+)"), re.compile(r"^(\d+)")
_END = (b"\r\n\r\n", b"\n\n")


def again(f: Callable[[], Any], retries: int, pause: float = 0.2) -> Any:
    """f(), tried again after errors of the file system."""
    for turn in range(retries + 1):
        try:
            return f()
        except FileNotFoundError:
            raise
        except OSError:
            if turn == retries:
                raise
            time.sleep(pause * 2**turn)


def listed(path: str) -> dict[str, dict[int, str]]:
    """{folder: {uid: file}}; an mbox file is one folder."""
    if not os.path.isdir(path):
        return {"INBOX": dict.fromkeys(range(1, len(mailbox.mbox(path, create=False)) + 1), path)}
    out: dict[str, dict[int, str]] = {}
    for name in ["", *sorted(n for n in os.listdir(path) if n.startswith(".") and os.path.isdir(os.path.join(path, n)))]:
        own = out.setdefault(name.lstrip(".") or "INBOX", {})
        for part in ("new", "cur"):
            folder = os.path.join(path, name, part)
            for file in os.listdir(folder) if os.path.isdir(folder) else []:
                if found := next((m for p in _UIDS if (m := p.search(file))), None):
                    own[int(found.group(1))] = os.path.join(folder, file)
    return out


def fetch(path: str, uid: int, header_only: bool) -> bytes | None:
    """The bytes of a mail, or up to the end of its headers; None if it has gone."""
    try:
        with open(path, "rb") as file:
            if file.read(5) == b"From ":  # an mbox file
                return _head(mailbox.mbox(path, create=False).get_bytes(uid - 1)) if header_only else mailbox.mbox(path, create=False).get_bytes(uid - 1)
            file.seek(0)
            if not header_only:
                return file.read()
            held = b""
            while block := file.read(8_192):
                held += block
                if any(e in held for e in _END):
                    break
            return _head(held)
    except (FileNotFoundError, KeyError):
        return None


def _head(raw: bytes) -> bytes:
    ends = [raw.index(e) + len(e) for e in _END if e in raw]
    return raw[: min(ends)] if ends else raw


@dataclass
class Share(InputPartition):
    """Mails of one folder that one task reads."""

    folder: str
    mails: list[tuple[int, str]]


class MailboxStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.first = options["path"], int(options.get("first", FIRST))
        self.header_only, self.retries = options.get("phase", "mail") == "header", int(options.get("retries", 3))

    def _uids(self) -> dict[str, dict[int, str]]:
        return again(lambda: listed(self.path), self.retries)

    def initialOffset(self) -> dict:  # noqa: N802
        """Behind which a folder's newest `first` mails lie."""
        start = {}
        for folder, uids in self._uids().items():
            older = sorted(uids)[: -self.first] if self.first else sorted(uids)
            start[folder] = older[-1] if older else 0
        return start

    def latestOffset(self) -> dict:  # noqa: N802
        return {folder: max(uids, default=0) for folder, uids in self._uids().items()}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        """A folder that wasn't there at the start is read from its first mail."""
        out = []
        for folder, uids in self._uids().items():
            own = [(u, uids[u]) for u in sorted(uids) if start.get(folder, 0) < u <= end.get(folder, 0)]
            out += [Share(folder, own[at : at + SHARE]) for at in range(0, len(own), SHARE)]
        return out

    def read(self, partition: Share) -> Iterator[tuple]:
        for uid, path in partition.mails:
            content = again(lambda: fetch(path, uid, self.header_only), self.retries)  # noqa: B023 - called at once
            if content is not None:
                yield partition.folder, uid, path, content


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> MailboxStream:  # noqa: N802
        return MailboxStream(self.options)


def stream(spark: SparkSession, path: str, phase: str = "mail", first: int = FIRST):
    """The mails (SCHEMA) of a mailbox as a stream."""
    spark.dataSource.register(MailboxSource)
    return spark.readStream.format("mailbox").option("path", path).option("phase", phase).option("first", first).load()


def whole_mail(path: Column, uid: Column) -> Column:
    """The mails that headers belong to; null for those that have gone."""

    def run(paths: pd.Series, uids: pd.Series) -> pd.Series:
        return pd.Series([again(lambda: fetch(p, u, False), 3) for p, u in zip(paths, uids, strict=True)], dtype=object)  # noqa: B023

    run.__annotations__ = {"paths": pd.Series, "uids": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(path, uid)
