"""WARC archives: write pages with revisit records, read them back with salvage.

Writing: each record is a gzip member of its own.  Of records with equal payloads
the one with the smallest id is a ``response``, the others are ``revisit`` records
that refer to it.  Tasks roll files in the shared folder under names of their own
and list them in a manifest; a file of a lost task is in no manifest.

Reading streams each file, whose members may hold one record or many, or which may not
be compressed.  A record whose header, length or digest fails, a member that does not
decompress, or bytes that are no record at all are quarantined: the reader searches
for the next version line (in a member, among its decompressed bytes) or member, goes
on there, and logs the gap's byte range and reason.  A claimed length is checked
piece by piece before the record is held, so that a false one reads on but holds
nothing; the reader goes back by seeking.

A null html is an empty payload, a null id is kept apart from an empty one, ids may
hold any signs, a null url is left out.  Repeated rows (equal id and payload) are all
responses, being the smallest id alike.  An empty table gives one empty manifest;
other columns are not archived.  A record is held in memory whole, a file never is.
A third of all pages may have one payload: payloads of more than a thousandth of all
pages, fewer than a thousand, are broadcast, so that no task gets all pages of one.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm.common import join_spread, map_rows, materialise, scratch_dir

FILE_BYTES = 8 << 20
CHUNK = 1 << 20
STEP = 1 << 12
HELD = 32 << 20  # bytes of a header, and of a record before its checks have passed, that are held at most
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = "1970-01-01T00:00:00Z", revisit: bool = False) -> bytes:
    """One record, not compressed.  A revisit keeps the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    name = lambda x: "<urn:x-page-null>" if x is None else f"<urn:x-page:{quote(str(x), safe='')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _open(uri: str, write: bool):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)  # records are compressed one by one
    return system.open_input_file(path)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` (page_id, url, html); returns the manifest (path, n_records, n_bytes)."""
    folder = folder or scratch_dir(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).alias("n"))
    groups = p.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("many"))
    groups = materialise(groups.filter((F.col("n") >= min_bytes) & (F.col("many") > 1)))
    joined = join_spread(p, groups.withColumn("group", F.struct("first")), ["sha1", "n"], "group", pages.count(), F.xxhash64("page_id", "url")).withColumn("first", F.col("group.first"))
    revisit = F.col("group").isNotNull() & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return materialise(map_rows(joined.withColumn("revisit", revisit), ["page_id", "url", "html", "sha1", "first", "revisit"], "path string, n_records long, n_bytes long", lambda: _Writer(folder, file_bytes, date)))


class _Writer:
    """Writes a task's rows to files of about ``file_bytes``, and lists them when they are closed."""

    def __init__(self, folder: str, file_bytes: int, date: str):
        self.folder, self.file_bytes, self.date, self.out = folder, file_bytes, date, None
        self.path, self.n, self.size = "", 0, 0

    def __call__(self, c: list[list]) -> Iterator[tuple]:
        for page_id, url, text, sha1, first_id, again in zip(*c, strict=True):
            if self.out is None:
                self.path, self.n, self.size = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                self.out = _open(self.path, True)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            data = member(record(page_id, url, text.encode("utf-8", "surrogatepass"), digest, first_id, self.date, again))
            self.out.write(data)
            self.n, self.size = self.n + 1, self.size + len(data)
            if self.size >= self.file_bytes:
                yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.path, self.n, self.size


class _Window:
    """A forward view of bytes: those from ``base`` on, as many as were asked for.

    ``open_at`` gives a function that reads the next piece from a place on; the window
    can go back by opening again.  ``last`` is where the bytes end, once that was seen;
    with ``jumps`` opening at a place reads nothing before it.
    """

    def __init__(self, open_at: Callable[[int], Callable[[], bytes]], jumps: bool = False):
        self.open_at, self.jumps = open_at, jumps
        self.last: int | None = None
        self.go(0)

    def go(self, place: int) -> None:
        if hasattr(self, "buf") and self.base <= place <= self.base + len(self.buf):
            self.drop(place - self.base)
        else:
            self.base, self.buf, self.done, self.read = place, bytearray(), False, self.open_at(place)

    def more(self) -> bool:
        data = b"" if self.done else self.read()
        self.done = not data
        self.buf += data
        if self.done:
            self.last = self.base + len(self.buf)
        return bool(data)

    def ends_at(self, place: int) -> str:
        """What is wrong if a record is said to end at a place far on; the window stays where it is."""
        base, read, tail = self.base, self.open_at(place - 4), b""
        while len(tail) < 4 and (data := read()):
            tail += data
        self.base, self.buf, self.done, self.read = base, bytearray(), False, self.open_at(base)
        return "" if tail[:4] == b"\r\n\r\n" else "record cut off" if len(tail) < 4 else "record does not end where it says"

    def have(self, n: int) -> bool:
        while len(self.buf) < n and self.more():
            pass
        return len(self.buf) >= n

    def drop(self, n: int) -> None:
        del self.buf[:n]
        self.base += n

    def from_(self, place: int) -> Iterator[bytes]:
        """Pieces from a place on; what was given is forgotten once it is long."""
        size = 1 << 14
        while place < self.base + len(self.buf) or self.more():
            piece = bytes(self.buf[place - self.base : place - self.base + size])
            place, size = place + len(piece), min(size * 4, CHUNK)
            if place - self.base > HELD:
                self.drop(place - self.base)
            yield piece

    def find_next(self, marks: tuple[bytes, ...]) -> bool:
        """Go to the next place where one of the marks stands; False at the end."""
        while True:
            hits = [i for i in map(self.buf.find, marks) if i >= 0]
            if hits:
                self.drop(min(hits))
                return True
            self.drop(max(0, len(self.buf) - max(map(len, marks)) + 1))
            if not self.more():
                self.drop(len(self.buf))
                return False


class _Member:
    """The content of a gzip member, in pieces; ``why`` says what is wrong with it."""

    def __init__(self, win: _Window, begin: int):
        self.win, self.begin = win, begin
        self.why: str | None = None
        self.end: int | None = None
        self.fed = begin

    def open_at(self, place: int) -> Callable[[], bytes]:
        if self.fed != self.begin:
            self.win.go(self.begin)
        self.why, self.end, self.fed = None, None, self.begin
        pieces = self._content()
        while place > 0 and (piece := next(pieces, b"")):
            if len(piece) > place:
                pieces = itertools.chain([piece[place:]], pieces)
            place -= min(place, len(piece))
        return lambda: next(pieces, b"")

    def _content(self) -> Iterator[bytes]:
        d = zlib.decompressobj(31)
        try:
            for data in self.win.from_(self.begin):
                # small steps: what lies before a broken place is still given out
                for at in range(0, len(data), STEP):
                    part = data[at : at + STEP]
                    self.fed += len(part)
                    while part and not d.eof:
                        piece = d.decompress(part, CHUNK)
                        part = d.unconsumed_tail
                        if d.eof:
                            self.end = self.fed = self.fed - len(d.unused_data)
                        if piece:
                            yield piece
                    if d.eof:
                        return
            self.why = "member cut off"
        except zlib.error:
            self.why = "member does not decompress"


def parse_header(data: bytes) -> tuple[dict[str, str], int] | str:
    """(headers, bytes of the block) of a record's header, or what is wrong with it."""
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = head.get("content-length", "")
    return (head, int(size)) if size.isascii() and size.isdigit() and len(size) <= 18 else "no length"


def _record(win: _Window) -> tuple[dict[str, str], bytes] | str:
    """The record at the window's start, which goes behind it, or what is wrong with it; the window then stands where it stood."""
    begin = win.base
    end, seen = -1, 0
    while end < 0:
        end = win.buf.find(b"\r\n\r\n", seen)
        # a header holds no version line: where one comes first, this one has no end
        if win.buf.find(b"\n" + _VERSION, seen, end if end >= 0 else len(win.buf)) >= 0:
            return "no end of header"
        seen = max(0, len(win.buf) - len(_VERSION))
        if end < 0 and (len(win.buf) >= HELD or not win.more()):
            return "no end of header"
    got = parse_header(bytes(win.buf[:end]))
    if isinstance(got, str):
        return got
    head, size = got
    want = head.get("warc-block-digest", "")
    whole = end + 4 + size + 4
    if win.last is not None and begin + whole > win.last:
        return "record cut off"
    if whole > HELD and win.jumps and (why := win.ends_at(begin + whole)):
        return why
    if whole > HELD:  # a piece at a time, before it is held
        digest, left, tail = hashlib.sha1(), size, b""
        for piece in win.from_(begin + end + 4):
            digest.update(piece[:left])
            tail += piece[left:]
            left = max(0, left - len(piece))
            if left == 0 and len(tail) >= 4:
                break
        why = "record cut off" if left or len(tail) < 4 else "record does not end where it says" if tail[:4] != b"\r\n\r\n" else ""
        if not why and want and want != f"sha1:{base64.b32encode(digest.digest()).decode()}":
            why = "block digest differs"
        win.go(begin)
        if why:
            return why
    if not win.have(whole):
        return "record cut off"
    if win.buf[whole - 4 : whole] != b"\r\n\r\n":
        return "record does not end where it says"
    block = bytes(win.buf[end + 4 : whole - 4])
    if want and want != f"sha1:{base32_sha1(block)}":
        return "block digest differs"
    win.drop(whole)
    return head, block


def _scan(win: _Window, members: bool) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of the window, in order; of neighbouring gaps one."""
    marks = (_MAGIC, _VERSION) if members else (_VERSION,)
    gap: tuple[int, str] | None = None
    while win.have(1):
        begin, why = win.base, "no member or version line"
        win.have(len(_VERSION))
        if win.buf.startswith(_VERSION):
            got = _record(win)
            if not isinstance(got, str):
                if gap:
                    yield "gap", gap[0], begin, gap[1]
                    gap = None
                yield "record", begin, win.base, got
                continue
            why = got
        elif members and win.buf.startswith(_MAGIC):
            m = _Member(win, begin)
            lost, n, held = [], 0, []  # the first record waits: alone, it counts if its member is good
            for status, a, b, what in itertools.chain(_scan(_Window(m.open_at), False), [("end", 0, 0, None)]):
                if status == "gap":
                    lost.append((a, b, what))
                    continue
                if held and (status == "record" or m.why is None and m.end is not None):
                    if gap:
                        yield "gap", gap[0], begin, gap[1]
                        gap = None
                    yield held.pop()
                if status == "record":
                    n += 1
                    if n == 1:
                        held.append((status, begin, m.fed, what))
                    else:
                        yield status, begin, m.fed, what
            if m.why is None and m.end is not None:
                win.go(m.end)
                if lost and not n:
                    gap = gap or (begin, lost[0][2])
                elif lost:
                    yield "gap", begin, m.end, "; ".join(f"{what} at {a} to {b} of the member's content" for a, b, what in lost[:20]) + (f"; {len(lost)} such" if len(lost) > 20 else "")
                continue
            why = m.why or "member cut off"
            win.go(begin)
        gap = gap or (begin, why)
        win.go(begin + 1)
        if not win.find_next(marks):
            break
    if gap:
        yield "gap", gap[0], win.base, gap[1]


def salvage(stream) -> Iterator[tuple[str, int, int, object]]:
    """("record", begin, end, (headers, block)) and ("gap", begin, end, reason), in file order.

    Records of one member have its begin, and as end how far the file had been read into
    it.  A gap inside a good member that has records as well has the member's range, and
    its reason names the places in the content.  Where a member fails behind two or more
    good records, these count and the gap has the member's begin; a member of one record
    counts only whole.
    """

    def open_at(place: int) -> Callable[[], bytes]:
        stream.seek(place)
        return lambda: stream.read(CHUNK)

    yield from _scan(_Window(open_at, jumps=True), True)


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files (column path), a task for each few files.

    status is record, gap or, for a payload that differs from its digest, damaged.
    Gaps have path, begin_byte, end_byte and reason; records also page_id (text), url,
    record_type, refers_to (text), payload_bytes, payload_digest, payload.
    """
    n = manifest.count()
    schema = "path string, begin_byte long, end_byte long, status string, reason string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"

    def strip(x: str | None) -> str | None:
        m = re.fullmatch(r"<urn:x-page:(.*)>", x or "")
        return unquote(m[1]) if m else None if x == "<urn:x-page-null>" else x


    def run(c) -> Iterator[tuple]:
        for (path,) in zip(*c, strict=True):
            with _open(path, False) as stream:
                for status, begin, end, what in salvage(stream):
                    if status == "gap":
                        yield path, begin, end, status, what, *[None] * 7
                        continue
                    head, block = what
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
                    size, why = len(payload), None
                    if kind == "revisit":
                        m = re.search(rb"(?i)content-length:\s*(\d+)", http)
                        size = int(m[1]) if m else None
                    elif digest != base32_sha1(payload):
                        why = "payload digest differs"
                    yield path, begin, end, "damaged" if why else "record", why, strip(head.get("warc-record-id")), head.get("warc-target-uri"), kind, strip(head.get("warc-refers-to")), size, digest, payload if with_payload else None

    return map_rows(manifest.select("path").repartition(max(1, min(n, 10_000))), ["path"], schema, lambda: run)
