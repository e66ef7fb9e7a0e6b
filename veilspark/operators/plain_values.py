"""Plain values found in texts, all of them in one pass.

A value that its pattern takes literally is looked up in the folded text. The
values of a project are the paths of a trie below the project's root; it is
walked from every place of a batch of texts at once, letter by letter, until no
place is left. A text costs its length times the few letters that places stay
alive, however many values there are. Runs of white space count as one blank,
as the patterns have it; offsets are those of the text as it is.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

#: What a value may be edged by: nothing asked, or no letter on either side.
FREE, EDGED = 0, 1
#: Letters of a value that are nodes; the rest of a longer one is compared.
DEPTH = 256
#: Code points of texts that are walked at a time.
CHUNK = 1 << 19

# Workers get this module with the function: they need not be able to import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "array<struct<start:int,end:int,hit:string,value_id:bigint>>"
_STRUCT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hit", pa.string()), ("value_id", pa.int64())])

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Folded letters of the edge rule: basic Latin, Russian and old forms of Russian letters.
_LETTERS = [*range(ord("a"), ord("z") + 1), *range(ord("а"), ord("я") + 1), ord("ё"), *range(0x1C80, 0x1C87)]
_CODES = 0x110000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PlainValues:
    """Trie over distinct rows (project, edge, folded value, value id)."""

    def __init__(self, projects: Sequence[str], edges: Sequence[int], values: Sequence[str], ids: Sequence[int]):
        roots: dict[tuple[str, int], int] = {}
        node = np.array([roots.setdefault(key, len(roots)) for key in zip(projects, edges)], np.int64)
        self.roots = roots
        self.ids = np.asarray(ids, np.int64)
        self.sizes = np.array([len(v) for v in values], np.int64)
        begins = np.cumsum(self.sizes) - self.sizes
        flat = _codes("".join(values))
        alphabet = np.unique(flat)
        self.n_classes = len(alphabet) + 1
        self.class_of = np.zeros(_CODES, np.int32)
        self.class_of[alphabet] = np.arange(1, self.n_classes)
        classes = self.class_of[flat].astype(np.int64)
        self.first_two = np.zeros((2, self.n_classes, self.n_classes), bool)
        edge = np.asarray(edges, np.int64)
        keys, n_nodes = [], len(roots)
        ends = [np.full(n_nodes, -1, np.int64)]
        longer: dict[int, list[tuple[int, str]]] = {}
        alive = np.arange(len(values))
        for depth in range(DEPTH):
            alive = alive[self.sizes[alive] > depth]
            if not len(alive):
                break
            letter = classes[begins[alive] + depth]
            if depth == 0:
                single = alive[self.sizes[alive] == 1]
                self.first_two[edge[single], classes[begins[single]]] = True
                more = alive[self.sizes[alive] > 1]
                self.first_two[edge[more], classes[begins[more]], classes[begins[more] + 1]] = True
            made, child = np.unique(node[alive] * self.n_classes + letter, return_inverse=True)
            keys.append(made)
            node[alive] = n_nodes + child
            n_nodes += len(made)
            end = np.full(len(made), -1, np.int64)
            done = self.sizes[alive] == depth + 1
            end[child[done]] = alive[done]
            ends.append(end)
        for i in np.flatnonzero(self.sizes > DEPTH):
            longer.setdefault(int(node[i]), []).append((int(i), values[i][DEPTH:]))
        self.ends = np.concatenate(ends)
        self.longer = longer
        made = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self._hash(made, np.arange(len(roots), n_nodes, dtype=np.int32))

    def _hash(self, keys: np.ndarray, children: np.ndarray) -> None:
        """Open addressing: two to four slots a key."""
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_child = np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[slot[left]] < 0]
            place, first = np.unique(slot[free], return_index=True)
            self.slot_key[place], self.slot_child[place] = keys[free[first]], children[free[first]]
            left = left[self.slot_key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """The node each key (node, letter) leads to, or -1."""
        slot = self._slot(keys)
        held = self.slot_key[slot]
        child = np.where(held == keys, self.slot_child[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.slot_key[slot[left]]
            hit = held == keys[left]
            child[left[hit]] = self.slot_child[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return child

    def _walk(self, classes: np.ndarray, places: np.ndarray, nodes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of all hits that begin at ``places``."""
        at, which = [], []
        for depth in range(DEPTH):
            child = self._children(nodes * self.n_classes + classes[places + depth])
            going = child >= 0
            places, nodes = places[going], child[going].astype(np.int64)
            if not len(places):
                break
            value = self.ends[nodes]
            found = np.flatnonzero(value >= 0)
            at.append(places[found])
            which.append(value[found])
        else:
            for place, node in zip(places.tolist(), nodes.tolist()):
                same = [i for i, rest in self.longer.get(node, ()) if text.startswith(rest, place + DEPTH)]
                at.append(np.full(len(same), place, np.int64))
                which.append(np.array(same, np.int64))
        nothing = [np.zeros(0, np.int64)]
        return np.concatenate(at or nothing), np.concatenate(which or nothing)

    def hits(self, projects: list, texts: list, evens: list, overlapping: bool) -> tuple[np.ndarray, pa.Array]:
        """Number of hits of each text, and all hits in order of place."""
        evens = [e if e is not None else "" for e in evens]
        lengths = np.array([len(e) for e in evens], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        # a folded text holds blanks for all white space: a line break parts the texts
        text = "\n".join(evens) + "\n"
        codes = _codes(text)
        unit = np.repeat(np.arange(len(evens)), lengths + 1)
        origin = None
        twice = (codes[1:] == 32) & (codes[:-1] == 32)
        if twice.any():
            origin = np.flatnonzero(np.concatenate([[True], ~twice]))
            codes, unit = codes[origin], unit[origin]
            text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        classes = self.class_of[codes]
        ahead = np.concatenate([classes[1:], [0]])
        padded = np.concatenate([classes, np.zeros(DEPTH, np.int32)]).astype(np.int64)
        at, which = [], []
        for edge in {e for _, e in self.roots}:
            begin = self.first_two[edge][classes, ahead]
            if edge == EDGED:
                letter = np.isin(codes, _LETTERS)
                begin[1:] &= ~letter[:-1]
            root = np.array([self.roots.get((p, edge), -1) for p in projects], np.int64)
            places = np.flatnonzero(begin)
            nodes = root[unit[places]]
            known = nodes >= 0
            place, value = self._walk(padded, places[known], nodes[known], text)
            if edge == EDGED:
                free = ~letter[place + self.sizes[value]]
                place, value = place[free], value[free]
            at.append(place)
            which.append(value)
        place, value = np.concatenate(at), np.concatenate(which)
        if not overlapping:
            place, value = self._apart(place, value)
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        last = place + self.sizes[value] - 1
        of = unit[place]
        if origin is not None:
            place, last = origin[place], origin[last]
        start, end = place - begins[of], last + 1 - begins[of]
        shown = [texts[u][s:e] for u, s, e in zip(of.tolist(), start.tolist(), end.tolist())]
        found = pa.StructArray.from_arrays(
            [pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(shown, pa.string()), pa.array(self.ids[value])],
            fields=list(_STRUCT),
        )
        return np.bincount(of, minlength=len(evens)), found

    def _apart(self, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the hits of one value, those a search finds that goes on behind
        each hit."""
        order = np.lexsort((place, value))
        place, value = place[order], value[order]
        size = self.sizes[value]
        meets = np.zeros(len(place), bool)
        meets[1:] = (value[1:] == value[:-1]) & (place[1:] < place[:-1] + size[:-1])
        keep = ~meets
        upto = -1
        for i in np.flatnonzero(meets).tolist():
            # a hit that meets none before it is kept
            upto = int(place[i - 1] + size[i - 1]) if keep[i - 1] else upto
            keep[i] = place[i] >= upto
        return place[keep], value[keep]


def find_values(spark: SparkSession, values: PlainValues, overlapping: bool):
    """Function of columns (project_id, text, folded text) that gives the
    ``HITS`` of a text. ``overlapping`` finds a value at every place, also
    inside its own hits."""
    shared = spark.sparkContext.broadcast(vars(values))

    @arrow_udf(HITS)
    def of_texts(project: pa.Array, text: pa.Array, even: pa.Array) -> pa.Array:
        trie = PlainValues.__new__(PlainValues)
        vars(trie).update(shared.value)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(even), 0), np.int64) + 1)
        counts, found, begin = [], [], 0
        while begin < len(even):
            done = ends[begin - 1] if begin else 0
            upto = max(int(np.searchsorted(ends, done + CHUNK, "right")), begin + 1)
            part = slice(begin, upto)
            n, hits = trie.hits(project[part].to_pylist(), text[part].to_pylist(), even[part].to_pylist(), overlapping)
            counts.append(n)
            found.append(hits)
            begin = upto
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))]).astype(np.int32)
        hits = pa.concat_arrays(found) if found else pa.array([], _STRUCT)
        return pa.ListArray.from_arrays(pa.array(offsets), hits)

    return of_texts
