"""Capture records in byte buffers: where they start, and how a file's pieces fit together.

A file is read in pieces of any size, cut anywhere. Each piece is first walked
from a guessed first record (index); then the pieces of a file are joined in
order, and a guess that doesn't meet the end of what came before is walked
again from the right place (joined). So guesses only save work, they never
decide.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np

#: Bytes of a record's head, and of a piece's begin in files of blocks, where an interface may be told.
HEAD, LEAD = 16, 1 << 12
#: Bytes of the longest frame that captures may hold; a longer one breaks the file off.
LONGEST = 1 << 18
#: What a guess believes: as many records in a row, and as many seconds between neighbours.
BELIEVED_RECORDS, BELIEVED_GAP = 64, 7 * 86_400
LATEST = (1 << 63) - 1
SECTION = b"\x0a\x0d\x0d\x0a"


@dataclass(frozen=True)
class Layout:
    """How a file's records are written: classic or in blocks, byte order, ticks of a microsecond, and of blocks the interfaces' ticks of a second."""

    blocks: bool
    order: str
    per_us: int = 1
    units: tuple[int, ...] = ()


def layout_of(head: bytes) -> tuple[Layout, int] | None:
    """The layout that a file's first bytes tell, and where its records begin."""
    magic = head[:4]
    if magic == SECTION:
        return Layout(True, "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), 0
    for order in "<>":
        for value, per_us in ((0xA1B2C3D4, 1), (0xA1B23C4D, 1000)):
            if magic == struct.pack(order + "I", value):
                return Layout(False, order, per_us), 24
    return None


def resolution(options: bytes, order: str) -> int:
    """Ticks per second of an interface: option 9, else microseconds."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 9 and size and at + 4 < len(options):
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        at += 4 + -(-size // 4) * 4
    return 1_000_000


@dataclass
class Walk:
    """Whole records of a buffer: start of frame, size and time of each, where the walk stopped, and the layout there.

    broken: what comes next can't be a record.
    """

    starts: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    at: int
    layout: Layout
    broken: bool = False


def numbers(buffer: np.ndarray, at: np.ndarray, width: int, order: str) -> np.ndarray:
    """Unsigned numbers of 2 or 4 bytes at places of a buffer."""
    if not len(at):
        return np.zeros(0, np.int64)
    return buffer[at[:, None] + np.arange(width)].view(f"{order}u{width}").ravel().astype(np.int64)


def walk(data: bytes, at: int, layout: Layout, end: int | None = None) -> Walk:
    """The records from a place on that the buffer holds whole."""
    end = len(data) if end is None else end
    if layout.blocks:
        return _walk_blocks(data, at, layout, end)
    heads, broken, read = [], False, struct.Struct(layout.order + "I").unpack_from
    while at + HEAD <= end:
        size = read(data, at + 8)[0]
        if size > LONGEST:
            broken = True
            break
        if at + HEAD + size > end:
            break
        heads.append(at)
        at += HEAD + size
    heads = np.array(heads, np.int64)
    buffer = np.frombuffer(data, np.uint8)
    seconds, part, sizes = (numbers(buffer, heads + k, 4, layout.order) for k in (0, 4, 8))
    return Walk(heads + HEAD, sizes, seconds * 1_000_000 + part // layout.per_us, at, layout, broken)


def _walk_blocks(data: bytes, at: int, layout: Layout, end: int) -> Walk:
    order, units = layout.order, list(layout.units)
    starts, sizes, times, broken = [], [], [], False
    while at + 12 <= end:
        if data[at : at + 4] == SECTION:
            order, units = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "2I", data, at)
        if size < 12:
            broken = True
            break
        if at + size > end:
            break
        if kind == 1:
            units.append(resolution(data[at + 16 : at + size - 4], order))
        elif kind == 6 and size >= 32:
            face, high, low, length = struct.unpack_from(order + "4I", data, at + 8)
            if length > LONGEST:
                broken = True
                break
            unit = units[face] if face < len(units) else 1_000_000
            starts.append(at + 28)
            sizes.append(min(length, size - 32))
            times.append(min(((high << 32) | low) * 1_000_000 // unit, LATEST) if unit > 0 else 0)
        at += size
    layout = replace(layout, order=order, units=tuple(units))
    return Walk(np.array(starts, np.int64), np.array(sizes, np.int64), np.array(times, np.int64), at, layout, broken)


def guess(data: bytes, layout: Layout) -> int | None:
    """A place in a buffer from which records seem to go on; it may be wrong."""
    reach = min(len(data), LONGEST + HEAD)
    buffer = np.frombuffer(data, np.uint8)
    if layout.blocks:
        places = np.arange(0, max(0, reach - 12))
        kind, size = (numbers(buffer, places + k, 4, layout.order) for k in (0, 4))
        likely = places[((kind <= 10) | (kind == 0x0A0D0D0A)) & (kind > 0) & (size % 4 == 0) & (size >= 12) & (size <= LONGEST)]
    else:
        places = np.arange(0, max(0, reach - HEAD))
        seconds, part, size, whole = (numbers(buffer, places + k, 4, layout.order) for k in (0, 4, 8, 12))
        likely = places[(seconds > 0) & (part < 1_000_000_000) & (size <= LONGEST) & (size <= whole) & (whole <= LONGEST)]
    return next((int(p) for p in likely if _goes_on(data, int(p), layout)), None)


def _goes_on(data: bytes, at: int, layout: Layout) -> bool:
    """Whether plausible records follow each other from a place, until there are many or the buffer ends."""
    end, before, begin = len(data), None, at
    for n in range(BELIEVED_RECORDS):
        if layout.blocks:
            if at + 12 > end:
                return n > 0
            kind, size = struct.unpack_from(layout.order + "2I", data, at)
            if size < 12 or size % 4 or size > LONGEST:
                return False
            if at + size > end:
                return n > 0
            if struct.unpack_from(layout.order + "I", data, at + size - 4)[0] != size:
                return False
            at += size
        else:
            if at + HEAD > end:
                return n > 0
            seconds, part, size, whole = struct.unpack_from(layout.order + "4I", data, at)
            if not seconds or part >= 1_000_000_000 or size > whole or whole > LONGEST or (before is not None and abs(seconds - before) > BELIEVED_GAP):
                return False
            before, at = seconds, at + HEAD + size
    return at > begin


@dataclass
class Piece:
    """What is known of a piece of a file: its bytes, the first of them, and for each layout tried the first record's place and what a walk from there found."""

    n: int
    lead: bytes
    entries: list[Entry] = field(default_factory=list)


@dataclass
class Entry:
    """A walk through a piece: from at on count records, then open bytes of one that isn't whole.

    at may lie beyond the piece. open: where the open record starts; head: the
    first bytes of it; sections: whether a section started in between, so that
    interfaces before don't count; units: interfaces that were told.
    """

    blocks: bool
    order: str
    at: int
    count: int
    open: int
    head: bytes
    order_after: str
    sections: bool
    units: tuple[int, ...]
    broken: bool


def _entry(data: bytes, at: int, layout: Layout) -> Entry:
    if at >= len(data):
        return Entry(layout.blocks, layout.order, at, 0, at, b"", layout.order, False, (), False)
    mark = -1  # an interface that can't be told: gone after the walk if a section started
    found = walk(data, at, replace(layout, units=(mark,)))
    sections = mark not in found.layout.units
    units = tuple(u for u in found.layout.units if u != mark)
    head = data[found.at : found.at + (LEAD if layout.blocks else HEAD)]
    return Entry(layout.blocks, layout.order, at, len(found.starts), found.at, head, found.layout.order, sections, units, found.broken)


LAYOUTS = tuple(Layout(blocks, order) for blocks in (False, True) for order in "<>")


def index(data: bytes, first: bool, at: int | None = None, layout: Layout | None = None) -> Piece:
    """What a piece tells by itself. first: it begins the file; at and layout: where it is known to go on."""
    piece = Piece(len(data), b"")
    if at is not None:
        piece.entries.append(_entry(data, at, layout))
    elif first:
        if told := layout_of(data):
            piece.entries.append(_entry(data, told[1], told[0]))
    else:
        for tried in LAYOUTS:
            place = guess(data, tried)
            if place is not None:
                piece.entries.append(_entry(data, place, tried))
    enough = LONGEST + 2 * HEAD if not piece.entries else LEAD if any(e.blocks for e in piece.entries) else 2 * HEAD
    piece.lead = data[: max(enough, *(e.at for e in piece.entries))] if piece.entries else data[:enough]
    return piece


@dataclass(frozen=True)
class Part:
    """How to read a piece: the place and the layout of its first record, its first frame's number, where the piece ends, and what follows of the frame that its end cuts."""

    at: int
    layout: Layout
    first: int
    end: int
    more: bytes


def joined(pieces: list[Piece], size: int | None = None) -> tuple[list[Part | None], tuple[int, int, Layout] | None]:
    """How to read each piece of a file, as far as that is known; None for pieces in which no record begins.

    size: the file's bytes, if known; pieces may have a byte more, which the
    last then loses. The second value names the first piece whose guess was
    wrong, the place in it where records go on, and their layout; None if all
    pieces are settled.
    """
    parts: list[Part | None] = [None] * len(pieces)
    total = sum(p.n for p in pieces)
    over = int(size is not None and total == size + 1)
    told = layout_of(_leading(pieces, 24))
    if told is None:
        return parts, None
    layout, at = told
    base = number = 0
    frame = False
    for k, piece in enumerate(pieces):
        place, end = at - base, piece.n - (over if k == len(pieces) - 1 else 0)
        base += piece.n
        if place >= piece.n:  # a record goes on beyond this piece
            if frame and len(piece.lead) < piece.n:  # all of it is wanted
                return parts, (k, place, layout)
            continue
        frame = False
        found = next((e for e in piece.entries if e.blocks == layout.blocks and e.order == layout.order and e.at == place), None)
        if found is None:
            return parts, (k, place, layout)
        parts[k] = Part(place, layout, number, end, b"")
        layout = replace(layout, order=found.order_after, units=(() if found.sections else layout.units) + found.units)
        number, at = number + found.count, base - piece.n + found.open
        if found.broken:
            break
        if found.open < piece.n:
            rest = piece.n - found.open
            size_, frame, layout = _opened(found.head + _leading(pieces[k + 1 :], LEAD), layout)
            if not size_ or at + size_ > total - over:  # the file breaks off
                break
            at += size_
            if frame:
                parts[k] = replace(parts[k], more=_leading(pieces[k + 1 :], size_ - rest)[: size_ - rest])
                number += 1
    return parts, None


def _leading(pieces: list[Piece], need: int) -> bytes:
    """The bytes that follow a piece, as many as needed, as far as the next ones' first bytes tell them."""
    out = b""
    for piece in pieces:
        out += piece.lead
        if piece.n > len(piece.lead) or len(out) >= need:
            break
    return out


def _opened(head: bytes, layout: Layout) -> tuple[int, bool, Layout]:
    """Of a record that a piece leaves open: its bytes (0 if it is none), whether it holds a frame, and the layout after it."""
    if not layout.blocks:
        size = struct.unpack_from(layout.order + "I", head, 8)[0] if len(head) >= HEAD else LONGEST + 1
        return (HEAD + size if size <= LONGEST else 0), True, layout
    if len(head) < 12:
        return 0, False, layout
    if head[:4] == SECTION:
        layout = replace(layout, order="<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", units=())
    kind, size = struct.unpack_from(layout.order + "2I", head)
    if kind == 1:
        layout = replace(layout, units=(*layout.units, resolution(head[16 : max(16, size - 4)], layout.order)))
    frame = kind == 6 and size >= 32 and len(head) >= 24
    if frame and struct.unpack_from(layout.order + "I", head, 20)[0] > LONGEST:
        size = 0
    return (size if size >= 12 else 0), frame, layout


def chunks(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, Walk]]:
    """The records of a file that comes in pieces, each with the buffer that holds it; a buffer grows with the longest record only."""
    held, layout, begin = b"", None, 0
    for piece in pieces:
        held += piece
        if layout is None:
            if len(held) < 24:
                continue
            if (told := layout_of(held)) is None:
                return
            layout, begin = told
        found = walk(held, begin, layout)
        yield held, found
        if found.broken:
            return
        held, layout, begin = held[found.at :], found.layout, 0
