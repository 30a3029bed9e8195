"""A review export in an archive within an archive, read in one pass and written as tab-separated tables.

A zip holds a (gzipped) tar, whose JSON-lines members are read in archive order without unpacking to disk.  An
archive of this kind can only be read from its start, so this step is sequential; the tables it writes are
what review_tables reads in parallel.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from calendar import timegm
from collections.abc import Iterator
from pathlib import Path
from time import strptime


def members(path: str) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(base name, lines) of every file in the zip's tars; the lines of one are read before the next is asked for."""
    with zipfile.ZipFile(path) as outer:
        for name in outer.namelist():
            if not name.lower().endswith((".tar", ".tar.gz", ".tgz")):
                continue
            with outer.open(name) as packed, tarfile.open(fileobj=packed, mode="r|*") as inner:
                for member in inner:
                    found = inner.extractfile(member) if member.isfile() else None
                    if found is not None:
                        yield Path(member.name).name, io.BufferedReader(found, 1 << 20)


def parsed(lines: Iterator[bytes]) -> Iterator[dict]:
    for line in lines:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            yield row


def seconds(text: object) -> int | None:
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return timegm(strptime(str(text).strip(), form))
        except ValueError:
            continue
    return None


def listed(text: object) -> list[str]:
    return [x for x in dict.fromkeys(p.strip() for p in str(text or "").split(",")) if x and x != "None"]


def stream(path: str, out: str) -> dict[str, int]:
    """businesses, reviews, friends, categories (.tsv) and stream_meta.json in out; the numbers of rows.

    Reviews without a readable date are left out; all others are kept, the earliest of a user and business is
    chosen by whoever reads them.
    """
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    categories: dict[str, int] = {}
    counts = dict.fromkeys(("businesses", "reviews", "friends", "categories"), 0)
    files = {n: (folder / f"{n}.tsv").open("w", encoding="utf-8", newline="\n") for n in counts}

    def put(name: str, *cells: object) -> None:
        files[name].write("\t".join(str(c).replace("\t", " ").replace("\n", " ") for c in cells) + "\n")
        counts[name] += 1

    try:
        for name, lines in members(path):
            if name.endswith("_business.json"):
                for row in parsed(lines):
                    own = [categories.setdefault(c, len(categories)) for c in listed(row.get("categories"))]
                    put("businesses", row.get("business_id", ""), ",".join(map(str, own)))
            elif name.endswith("_review.json"):
                for row in parsed(lines):
                    at = seconds(row.get("date"))
                    if at is not None:
                        put("reviews", row.get("user_id", ""), row.get("business_id", ""), at)
            elif name.endswith("_user.json"):
                for row in parsed(lines):
                    put("friends", row.get("user_id", ""), ",".join(listed(row.get("friends"))))
        for text, number in categories.items():
            put("categories", number, text)
    finally:
        for f in files.values():
            f.close()
    if not any(counts.values()):
        raise FileNotFoundError(f"{path} holds no business, review or user table")
    (folder / "stream_meta.json").write_text(json.dumps(counts, sort_keys=True))
    return counts
