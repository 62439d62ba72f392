"""License scan: MinHash bands retrieve templates for text windows, shingle containment verifies.

Windows are laid over the five-word shingles of a text on a dyadic grid. A
template of m shingles is looked for in windows of one length: for m up to 4 in
all windows of m shingles, else in windows of five blocks of m/4 to m/2
shingles, one beginning at each block. Any run as long as the template lies in
one such window, and a window that holds 80 % of the template then has a
Jaccard similarity of at least 0.33. With 32 bands of one row such a window is
missed with a probability under 3e-6.

A band's value of a window is looked up among the templates' values of that
band, so the cost of a text doesn't depend on the number of templates. Texts
without any shingle of a template have no window that a band could retrieve,
and are left out before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import WordHash, folded_words, mix64, slices, utf8
from otflow.llm.license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
WINDOW_BLOCKS = 5
NOTHING = np.uint32(0xFFFFFFFF)
#: Leading bits of a shingle that are tried before the shingle itself.
MEMBER_BITS = 20


def shingles(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five tokens; of fewer tokens the whole run, of none nothing."""
    n = len(tokens)
    size = min(SHINGLE, n)
    out = np.full(max(n - SHINGLE + 1, min(n, 1)), size, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(3) + tokens[k : k + len(out)])
    return out


def geometry(m: int) -> tuple[int, int]:
    """Block and window length, in shingles, for templates of m distinct shingles."""
    if m <= 4:
        return 1, m
    block = 1 << ((m - 1).bit_length() - 2)
    return block, WINDOW_BLOCKS * block


def band_values(hashes: np.ndarray, band: int) -> np.ndarray:
    """The band's permuted 32-bit values of shingle hashes."""
    odd = mix64(np.array([band * 2 + 1], np.uint64))[0] | np.uint64(1)
    return np.minimum((hashes * odd) >> np.uint64(32), np.uint64(NOTHING - 1)).astype(np.uint32)


@dataclass(frozen=True)
class Templates:
    """Templates by name. They come from the program, not from data, so their size is known."""

    texts: Mapping[str, str]

    @cached_property
    def sets(self) -> list[tuple[str, np.ndarray]]:
        words = WordHash()
        out = [(name, np.unique(shingles(words.of(folded_words(text.encode()))))) for name, text in self.texts.items()]
        return [(name, found) for name, found in out if len(found)]

    @cached_property
    def by_geometry(self) -> dict[tuple[int, int], list[int]]:
        out: dict[tuple[int, int], list[int]] = {}
        for k, (_, found) in enumerate(self.sets):
            out.setdefault(geometry(len(found)), []).append(k)
        return dict(sorted(out.items()))

    @cached_property
    def lookup(self) -> dict[tuple[int, int, int], tuple[np.ndarray, dict[int, list[int]]]]:
        """For each band, block and window length the templates' least values, sorted, and the templates that have each."""
        out = {}
        for (block, window), members in self.by_geometry.items():
            for band in range(BANDS):
                of: dict[int, list[int]] = {}
                for t in members:
                    of.setdefault(int(band_values(self.sets[t][1], band).min()), []).append(t)
                out[band, block, window] = (np.array(sorted(of), np.uint32), of)
        return out

    @cached_property
    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """All templates' shingles, sorted, and which leading bits they have."""
        found = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in self.sets)]))
        bits = np.zeros(1 << MEMBER_BITS, bool)
        bits[found >> np.uint64(64 - MEMBER_BITS)] = True
        return found, bits

    def members(self, hashes: np.ndarray) -> bool:
        """Whether any of the shingles is one of a template."""
        found, bits = self.known
        maybe = hashes[bits[hashes >> np.uint64(64 - MEMBER_BITS)]]
        return bool(len(maybe)) and bool((found[np.minimum(np.searchsorted(found, maybe), len(found) - 1)] == maybe).any())


def scan_texts(texts: list[bytes], templates: Templates, words: WordHash) -> list[tuple[int, int, int, int]]:
    """(text, template, shingles matched, first shingle of the window) of the best window of each match."""
    runs = [shingles(words.of(folded_words(t))) for t in texts]
    kept = [k for k, run in enumerate(runs) if templates.members(run)]
    if not kept:
        return []
    runs = [runs[k] for k in kept]
    grid = max((g[0] for g in templates.by_geometry), default=1)
    # Each text begins on the coarsest block's edge, so windows don't depend on what stands before it.
    room = np.array([-(-len(r) // grid) * grid for r in runs], np.int64)
    first = np.cumsum(room) - room
    # Windows of the last text may reach beyond its end.
    hashes = np.zeros(int(room.sum()) + WINDOW_BLOCKS * grid, np.uint64)
    filled = np.zeros(len(hashes), bool)
    for at, run in zip(first.tolist(), runs):
        hashes[at : at + len(run)] = run
        filled[at : at + len(run)] = True
    found: set[tuple[int, int]] = set()
    for band in range(BANDS):
        level = np.where(filled, band_values(hashes, band), NOTHING)
        size = 1
        for block, window in templates.by_geometry:
            while size < block:
                level, size = level.reshape(-1, 2).min(1), size * 2
            reach = window // block
            least = level[: len(level) - reach + 1]
            for k in range(1, reach):
                least = np.minimum(least, level[k : k + len(least)])
            values, of = templates.lookup[band, block, window]
            hits = np.flatnonzero(values[np.minimum(np.searchsorted(values, least), len(values) - 1)] == least)
            for at, value in zip(hits.tolist(), least[hits].tolist()):
                found.update((t, at * block) for t in of[value])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for t, at in sorted(found):
        k = int(np.searchsorted(first, at, "right")) - 1
        begin = at - int(first[k])
        template = templates.sets[t][1]
        _, window = geometry(len(template))
        matched = len(np.intersect1d(runs[k][begin : begin + window], template))
        if matched >= CONTAINMENT * len(template) and matched > best.get((k, t), (0, 0))[0]:
            best[k, t] = (matched, begin)
    return [(kept[k], t, matched, begin) for (k, t), (matched, begin) in sorted(best.items())]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: doc_id, license, matched, shingles, containment, position.

    Case, punctuation and line breaks don't matter. matched: distinct shingles
    of the template in the best window (the first of several); position: the
    word where that window begins. Null and empty texts match nothing, repeated
    rows give rows each, a null doc_id stays null.
    """
    known = Templates(dict(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in slices(batches, 100):
            rows = scan_texts(utf8(batch.column(1)), known, words)
            if rows:
                k, t, matched, begin = zip(*rows)
                size = [len(known.sets[x][1]) for x in t]
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(k, pa.int64())),
                        pa.array([known.sets[x][0] for x in t]),
                        pa.array(matched, pa.int32()),
                        pa.array(size, pa.int32()),
                        pa.array([m / s for m, s in zip(matched, size)]),
                        pa.array(begin, pa.int32()),
                    ],
                    names=["doc_id", "license", "matched", "shingles", "containment", "position"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, license string, matched int, shingles int, containment double, position int")
