"""Operator 4 - removal of repeated word windows with suffix automata.

Shards of bounded size (see ``anchors``) bring together the text that can repeat.  In a
shard one suffix automaton takes in the regions in document order; before each word is
added, the matching statistic tells how long a passage ending there was seen before.
Passages from the threshold on are removed.

The automata are not broadcast to all documents: the repeated text they cover grows
with the corpus.  Each is built where its shard is, and only the regions that share an
anchor with the shard stream through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .anchors import Windows, remove_spans, repeated_spans
from .spark_util import keyed

WORD_WINDOWS = Windows("words", size=20, gram=8, shard_bytes=1_500_000)


class SuffixAutomaton:
    """Suffix automaton of several sequences; text taken in twice adds no states."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, q: int, length: int, p: int, c) -> int:
        r = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(length)
        self.link.append(self.link[q])
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def extend(self, last: int, c) -> int:
        """The state of the current sequence after ``c``; ``last`` is the state before it."""
        following, link, length = self.next, self.link, self.length
        q = following[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(q, length[last] + 1, last, c)
        state = len(length)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(q, length[p] + 1, p, c)
        return state

    def seen_before(self, sequence: list, least: int) -> list[tuple[int, int]]:
        """Take ``sequence`` in; maximal spans covered by matches of ``least`` or more.

        A match may lie in earlier sequences or earlier in this one, overlapping too.
        """
        following, link, length = self.next, self.link, self.length
        spans: list[tuple[int, int]] = []
        last = state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            to = following[state].get(c)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            last = self.extend(last, c)
            while state and length[link[state]] >= matched:  # a state may have been split
                state = link[state]
            if matched >= least:
                if spans and spans[-1][1] >= i + 1 - least:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - least, i + 1))
        return spans


def repeats_in_order(blobs: list[bytes], size: int = WORD_WINDOWS.size) -> list[list[tuple[int, int]]]:
    automaton, numbers = SuffixAutomaton(), {}
    return [automaton.seen_before([numbers.setdefault(x, len(numbers)) for x in blob.split()], size) for blob in blobs]


def _solver(size: int):
    return lambda blobs: repeats_in_order(blobs, size)


def substring_dedup(docs: DataFrame, windows: Windows = WORD_WINDOWS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its words without those in windows that also start earlier.

    A window is ``windows.size`` consecutive words ([^\\x20\\x09-\\x0D]+) of one document;
    earlier means a smaller id (null first, then by key), or the same document and an
    earlier start.  Documents with fewer words, empty and null texts stay as they are.
    Rows that repeat id and text are one document and both keep what it keeps.

    Returns id, kept (UTF-8, words joined by a space), n_elements (words), n_removed,
    n_spans (runs of removed words), and the columns ``carry``.
    """
    read = keyed(docs, *carry, id_col=id_col, text_col=text_col)
    spans = repeated_spans(read.select("id", "k", "text"), windows, _solver(windows.size), all_copies=False)
    return remove_spans(read, spans, windows, *carry)
