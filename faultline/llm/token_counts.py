"""Edit-aware token counts: a segment tree of pre-tokens per text, re-encoding only what an edit touches.

A text is cut into pre-tokens by the vocabulary's own pattern (a special token is one by
itself). They lie in runs of up to ``2 * FAN``; the runs are the nodes of a height-balanced
tree, and each node holds the characters and the tokens of its whole subtree. An edit
(character place, characters to delete, text to insert) descends by these sums, splits the
tree there, and takes out only the runs that it needs. The edited region is cut again
together with boundary context: from ``CONTEXT`` pre-tokens before the edit until the new
cuts fall back on old ones for as many pre-tokens in a row (the pattern looks at most one
character past a pre-token, and a special token is at most that many), so distant
pre-tokens keep their counts. The new runs are joined in, which renews the sums on the way
up and nothing else.

Trees can be kept: ``build_trees`` gives a row per text with its pre-tokens and their
counts, and ``edit_trees`` takes such rows and edits and gives rows of the same kind; what
an edit does not touch is not encoded again, however often rows are edited.

Null counts as empty. Edits beyond the end are clamped to it. Rows that repeat a doc_id
each give a row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_sql import masked, unmasked
from .tokens import CACHE_UNITS, Encoder, special_tokens

VOCABULARY = "byte_bpe_50k.json"
#: Leaves under one lowest node.
FAN = 64
#: Pre-tokens on either side of an edit that are cut again.
CONTEXT = 4


@cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def cut(text: str, file: str) -> list[str]:
    """The pre-tokens of a text; special tokens stand alone."""
    special = special_tokens(file)
    if special is None or not special.search(text):
        return _pattern().findall(text)
    out, at = [], 0
    for found in special.finditer(text):
        out += _pattern().findall(text[at : found.start()])
        out.append(found[0])
        at = found.end()
    return out + _pattern().findall(text[at:])


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, file: str = VOCABULARY):
        self.file, self.encoder = file, Encoder(file)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_UNITS:
            known.clear()
        out = list(map(known.get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    n = known.get(p)
                    if n is None:
                        special = special_tokens(self.file)
                        alone = special is not None and special.fullmatch(p)
                        n = known[p] = 1 if alone else len(self.encoder._unit(p.encode("utf-8", "surrogatepass"))) // 4
                    out[i] = n
        return out


class Node:
    """A run of pre-tokens with their counts, the subtrees left and right of it, and the sums of all three."""

    __slots__ = ("left", "pieces", "counts", "right", "height", "own_chars", "chars", "tokens")

    def __init__(self, left: Node | None, pieces: list[str], counts: list[int], right: Node | None, own_chars: int | None = None):
        self.left, self.pieces, self.counts, self.right = left, pieces, counts, right
        self.height = 1 + max(height(left), height(right))
        self.own_chars = sum(map(len, pieces)) if own_chars is None else own_chars
        self.chars = self.own_chars + chars(left) + chars(right)
        self.tokens = sum(counts) + (left.tokens if left else 0) + (right.tokens if right else 0)

    def over(self, left: Node | None, right: Node | None) -> Node:
        """The same run over other subtrees."""
        return Node(left, self.pieces, self.counts, right, self.own_chars)


def height(t: Node | None) -> int:
    return t.height if t else 0


def chars(t: Node | None) -> int:
    return t.chars if t else 0


def balanced(t: Node) -> Node:
    """One rotation or two where a side is two higher than the other."""
    if height(t.left) > height(t.right) + 1:
        low = t.left
        if height(low.right) > height(low.left):
            top = low.right
            return top.over(low.over(low.left, top.left), t.over(top.right, t.right))
        return low.over(low.left, t.over(low.right, t.right))
    if height(t.right) > height(t.left) + 1:
        low = t.right
        if height(low.left) > height(low.right):
            top = low.left
            return top.over(t.over(t.left, top.left), low.over(top.right, low.right))
        return low.over(t.over(t.left, low.left), low.right)
    return t


def join(left: Node | None, run: Node, right: Node | None) -> Node:
    """All of left, the run, all of right: down the higher side to where heights meet."""
    if height(left) > height(right) + 1:
        return balanced(left.over(left.left, join(left.right, run, right)))
    if height(right) > height(left) + 1:
        return balanced(right.over(join(left, run, right.left), right.right))
    return run.over(left, right)


def split(t: Node, place: int) -> tuple[Node | None, Node, Node | None]:
    """What lies left of the run that holds a character (the last run for the end), the run, and what lies right of it."""
    if place < chars(t.left):
        a, run, b = split(t.left, place)
        return a, run, join(b, t, t.right)
    if t.right is None or place < chars(t.left) + t.own_chars:
        return t.left, t, t.right
    a, run, b = split(t.right, place - chars(t.left) - t.own_chars)
    return join(t.left, t, a), run, b


def runs_of(t: Node | None):
    """The runs in order."""
    stack = []
    while stack or t:
        while t:
            stack.append(t)
            t = t.left
        t = stack.pop()
        yield t
        t = t.right


def built(pieces: list[str], counts: list[int]) -> Node | None:
    """A balanced tree of runs of FAN."""
    runs = [Node(None, pieces[i : i + FAN], counts[i : i + FAN], None) for i in range(0, len(pieces), FAN)]

    def middle(a: int, b: int) -> Node | None:
        m = (a + b) // 2
        return runs[m].over(middle(a, m), middle(m + 1, b)) if a < b else None

    return middle(0, len(runs))


class Tree:
    """The pre-tokens of one text, with sums of characters and tokens over every subtree."""

    def __init__(self, text: str, counter: Counter, kept: tuple[list[str], list[int]] | None = None):
        """kept: pre-tokens and counts of the text from before, which are not encoded again."""
        self.counter = counter
        pieces = cut(text, counter.file) if kept is None else kept[0]
        self.root = built(pieces, counter.counts(pieces) if kept is None else kept[1])
        self.encoded = len(pieces) if kept is None else 0

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    def leaves(self) -> tuple[list[str], list[int]]:
        runs = list(runs_of(self.root))
        return [p for r in runs for p in r.pieces], [n for r in runs for n in r.counts]

    def text(self) -> str:
        return "".join(self.leaves()[0])

    def edit(self, place: int, deleted: int, inserted: str) -> int:
        """Applies an edit; the number of pre-tokens that were encoded again."""
        length = chars(self.root)
        place = max(0, min(place, length))
        deleted = max(0, min(deleted, length - place))
        if not length:
            self.root = built(*(lambda p: (p, self.counter.counts(p)))(cut(inserted, self.counter.file)))
            new = len(self.leaves()[0])
            self.encoded += new
            return new
        left, run, right = split(self.root, place)
        start, pieces, counts = chars(left), list(run.pieces), list(run.counts)

        def leaf_of(at: int) -> int:
            here = start
            for k, piece in enumerate(pieces):
                here += len(piece)
                if at < here:
                    return k
            return len(pieces) - 1

        def more_right() -> bool:
            nonlocal right
            if right is None:
                return False
            _, run, right = split(right, 0)
            pieces.extend(run.pieces)
            counts.extend(run.counts)
            return True

        # From CONTEXT leaves before the edit to the leaf that holds its end.
        while leaf_of(place) < CONTEXT and left is not None:
            left, run, _ = split(left, left.chars)
            pieces[:0], counts[:0], start = run.pieces, run.counts, start - run.own_chars
        while start + sum(map(len, pieces)) <= place + deleted and more_right():
            pass
        first, last = max(0, leaf_of(place) - CONTEXT), leaf_of(place + deleted)
        before = start + sum(map(len, pieces[:first]))
        old = "".join(pieces[first : last + 1])
        head = old[: place - before] + inserted + old[place + deleted - before :]
        size = 4 * CONTEXT
        while True:
            # Leaves behind the region, by which it is seen whether the cuts agree again.
            while len(pieces) - last - 1 < size and more_right():
                pass
            more = pieces[last + 1 : last + 1 + size]
            new = cut(head + "".join(more), self.counter.file)
            if right is None and len(pieces) - last - 1 <= size:
                keep, used = len(new), len(more)
                break
            found = self._agree(new, head, more)
            if found:
                keep, used = found
                break
            size *= 2
        new = new[:keep]
        pieces[first : last + 1 + used], counts[first : last + 1 + used] = new, self.counter.counts(new)
        root = left
        for i in range(0, len(pieces), FAN):
            run = Node(None, pieces[i : i + FAN], counts[i : i + FAN], None)
            root = join(root, run, None)
        if right is not None:
            _, run, rest = split(right, 0)
            root = join(root, run, rest)
        self.root = root
        self.encoded += len(new)
        return len(new)

    @staticmethod
    def _agree(pieces: list[str], head: str, more: list[str]) -> tuple[int, int] | None:
        """(new pieces to keep, old leaves they use up) where CONTEXT cuts in a row are old ones, with more to see behind."""
        olds, at = {}, len(head)
        for i, leaf in enumerate(more):
            olds[at] = i
            at += len(leaf)
        here = 0
        for n, piece in enumerate(pieces):
            i = olds.get(here)
            if i is not None and i + CONTEXT + 1 < len(more) and pieces[n : n + CONTEXT] == more[i : i + CONTEXT]:
                return n, i
            here += len(piece)
        return None


def standing_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: a title in front, the character in the middle removed, a word put at one third, a closing line.

    Each place refers to the text as the edits before it left it.
    """
    n = len(text)
    return [(0, 0, "Title: draft 1\n"), ((n + 15) // 2, min(1, n), ""), ((n + 14) // 3, 0, " (sic) "), (n + 64, 0, "\nEnd.")]


def _counted(file: str, edits_column: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(file)
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("doc_id", "n_pretokens", "n_tokens", "edited_tokens", "reencoded")}
            for i, (doc, cell) in enumerate(zip(batch.column("doc_id"), batch.column("text"), strict=True)):
                text = (cell.as_py() or b"").decode("utf-8", "replace")
                tree = Tree(text, counter)
                own = standing_edits(text) if edits_column is None else [(e["place"], e["deleted"], e["inserted"] or "") for e in batch.column(edits_column)[i].as_py() or []]
                out["doc_id"].append(doc.as_py())
                out["n_pretokens"].append(tree.encoded)
                out["n_tokens"].append(tree.total)
                out["reencoded"].append(sum(tree.edit(*e) for e in own))
                out["edited_tokens"].append(tree.total)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def count_tokens(docs: DataFrame, edits: DataFrame | None = None, file: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, edited_tokens, reencoded per row of docs.

    edits: doc_id, edits array<struct<place int, deleted int, inserted string>> (in characters, applied in order);
    without it each text gets its ``standing_edits``. reencoded: pre-tokens that the edits had encoded again.
    """
    texts = masked(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    if edits is not None:
        texts = texts.join(masked(edits).select("doc_id", "edits"), "doc_id", "left")
    return unmasked(texts.mapInArrow(_counted(file, None if edits is None else "edits"), "doc_id long, n_pretokens long, n_tokens long, edited_tokens long, reencoded long"))


TREE = "doc_id long, text binary, lengths array<int>, counts array<int>, reencoded long"


def _tree_row(out: dict, doc, tree: Tree, reencoded: int) -> None:
    pieces, counts = tree.leaves()
    for k, v in zip(out, (doc, "".join(pieces).encode(), list(map(len, pieces)), counts, reencoded), strict=True):
        out[k].append(v)


def _tree_batch(out: dict) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def build_trees(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """A row per row of docs: doc_id, text, the lengths (in characters) of its pre-tokens, their token counts, and how many were encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(file)
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in TREE.split(", ")}
            for doc, cell in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                tree = Tree((cell.as_py() or b"").decode("utf-8", "replace"), counter)
                _tree_row(out, doc.as_py(), tree, tree.encoded)
            yield _tree_batch(out)

    return unmasked(masked(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, TREE))


def edit_trees(trees: DataFrame, edits: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """Rows of ``build_trees`` (or of this function) after edits (see ``count_tokens``); reencoded is what these edits had encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(file)
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in TREE.split(", ")}
            for row in batch.to_pylist():
                text, pieces, at = row["text"].decode(), [], 0
                for n in row["lengths"]:
                    pieces.append(text[at : at + n])
                    at += n
                tree = Tree(text, counter, (pieces, row["counts"]))
                _tree_row(out, row["doc_id"], tree, sum(tree.edit(e["place"], e["deleted"], e["inserted"] or "") for e in row["edits"] or []))
            yield _tree_batch(out)

    rows = masked(trees).select("doc_id", "text", "lengths", "counts").join(masked(edits).select("doc_id", "edits"), "doc_id", "left")
    return unmasked(rows.mapInArrow(run, TREE))
