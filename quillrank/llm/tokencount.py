"""Token counts that survive edits.

A text is cut into pre-tokens, whose token counts add up to the text's.  The pre-tokens lie in
blocks under a segment tree of (characters, tokens) sums.  An edit finds its blocks by
descending the tree, cuts again from the pre-token before it, and stops as soon as a new
pre-token starts where an old one started: from there on the text is the same, and a pre-token
depends on nothing before it and on two characters after it (white space leaves its last
character to the word that follows).  Only new pre-tokens are encoded,
and only the sums above the blocks they are in change.  The vocabulary's special string is a
pre-token of its own that cuts the text around it; where an edit makes or breaks one, the context
is longer by its length.

``stored`` keeps the trees as rows of (text, tokens) blocks, and ``edit_stored`` takes a batch of
edits to them: a block that no edit meets is neither cut nor encoded again, so batch after batch
costs what its edits touch.

Defined results: a null text is empty and has no tokens; a null list of edits is none; an edit
outside the text is moved to its nearest place and null parts of it count as 0 or empty; null
blocks are none; repeated rows are counted each; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import new_path, table, text_of

#: Pre-tokens in a block when a tree is built, and how many make it be built anew.
BLOCK, FULL = 64, 1024
#: Pre-tokens that one worker remembers.
MEMORY = 400_000


@lru_cache(maxsize=1)
def _cutter():
    return regex.compile(tokens.pattern()).findall


def pretokens(text: str, paths: tuple[str, str]) -> list[str]:
    """The vocabulary's pre-tokens of a text; the special string is one."""
    out: list[str] = []
    for i, part in enumerate(text.split(tokens.SPECIAL)):
        if i:
            out.append(tokens.SPECIAL)
        if tokens.is_common(part):
            out += _cutter()(part)
        elif part:
            out += [part[a:b] for _, (a, b) in tokens._slow(paths[0]).pre_tokenizer.pre_tokenize_str(part)]
    return out


class Counts(dict):
    """Token counts of pre-tokens, filled as they are asked for."""

    def __init__(self, paths: tuple[str, str]):
        self.paths = paths

    def __missing__(self, piece: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        n = self[piece] = len(tokens.encode(piece, self.paths))
        return n


class TokenTree:
    """One text's pre-tokens under a segment tree of sums; a block that came from storage is cut when an edit meets it."""

    def __init__(self, text: str, counts: Counts):
        self.counts, self.encoded = counts, 0
        pieces = pretokens(text, counts.paths)
        blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)]
        self._build([(b, sum(map(counts.__getitem__, b))) for b in blocks])

    @classmethod
    def stored(cls, blocks: list[tuple[str, int]], counts: Counts) -> TokenTree:
        """A tree from its blocks' texts and token counts."""
        tree = cls.__new__(cls)
        tree.counts, tree.encoded = counts, 0
        tree._build([(text, n) for text, n in blocks if text])
        return tree

    def _build(self, blocks: list[tuple[list[str] | str, int]]) -> None:
        self.blocks = [b for b, _ in blocks] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (block, n) in enumerate(blocks):
            self.chars[self.width + i] = len(block) if isinstance(block, str) else sum(map(len, block))
            self.tokens[self.width + i] = n
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _pieces(self, i: int) -> list[str]:
        """Block i's pre-tokens."""
        block = self.blocks[i]
        if isinstance(block, str):
            pieces, size = [], 0
            for piece in pretokens(block + self._ahead(i), self.counts.paths):
                if size >= len(block):
                    break
                pieces.append(piece)
                size += len(piece)
            if size != len(block):
                raise ValueError(f"a stored block of {len(block)} characters isn't cut at a pre-token")
            self.blocks[i] = block = pieces
        return block

    def _ahead(self, i: int) -> str:
        """The text behind block i that the end of its last pre-token may depend on, from as many blocks as that takes."""
        near, parts, size = len(tokens.SPECIAL), [], 0
        for b in self.blocks[i + 1 :]:
            if size >= near:
                break
            parts.append(b if isinstance(b, str) else "".join(b))
            size += len(parts[-1])
        text = "".join(parts)
        return tokens.SPECIAL if text.startswith(tokens.SPECIAL) else text[:2]

    def kept(self) -> list[tuple[str, int]]:
        """The blocks' texts and token counts, for storage."""
        texts = (b if isinstance(b, str) else "".join(b) for b in self.blocks)
        return [(t, self.tokens[self.width + i]) for i, t in enumerate(texts) if t]

    def _around(self, a: int, b: int) -> str:
        """Characters a to b of the text, from the blocks they lie in."""
        a = max(0, a)
        i, start = self._find(a)
        parts, end = [], start
        while end < b and i < len(self.blocks):
            parts.append(self.blocks[i] if isinstance(self.blocks[i], str) else "".join(self.blocks[i]))
            end += len(parts[-1])
            i += 1
        return "".join(parts)[a - start : max(a, b) - start]

    def _leaf(self, i: int, block: list[str]) -> None:
        self.chars[self.width + i] = sum(map(len, block))
        self.tokens[self.width + i] = sum(map(self.counts.__getitem__, block))

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one beyond the end) and where it starts."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.width, len(self.blocks) - 1), before

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(b) for b in self.blocks)

    def edit(self, at: int, drop: int, put: str) -> None:
        """Take ``drop`` characters out at ``at`` and put ``put`` there."""
        at = max(0, min(at, self.n_chars))
        drop = max(0, min(drop, self.n_chars - at))
        if not drop and not put:
            return
        near = len(tokens.SPECIAL) - 1
        before, after = self._around(at - near, at), self._around(at + drop, at + drop + near)
        special = tokens.SPECIAL in before + put + after or tokens.SPECIAL in before + self._around(at, at + drop) + after
        ahead = 2 + (len(tokens.SPECIAL) if special else 0)  # characters that a pre-token's end may depend on
        first, before = self._find(max(0, at - ahead))
        # A pre-token that ends so many characters before the edit stays; the next is cut again.
        head, start = 0, before
        for piece in self._pieces(first):
            if start + len(piece) > at - ahead:
                break
            start += len(piece)
            head += 1
        old = list(self.blocks[first][head:])
        last, end = first, start + sum(map(len, old))
        while True:
            while end < at + drop + ahead and last + 1 < len(self.blocks):  # the text after the edit, to cut on
                last += 1
                old += self._pieces(last)
                end += self.chars[self.width + last]
            whole = "".join(old)
            changed = whole[: at - start] + put + whole[at - start + drop :]
            found = self._meet(changed, old, at - start, drop, len(put), ahead, last + 1 == len(self.blocks))
            if found is not None:
                break
            last += 1  # no common start yet: take in one block more
            old += self._pieces(last)
            end += self.chars[self.width + last]
        new, kept = found
        self.encoded += len(new)
        self.blocks[first] = self.blocks[first][:head] + new + kept
        for i in range(first + 1, last + 1):
            self.blocks[i] = []
        if len(self.blocks[first]) > FULL:
            full = self.blocks[first]
            parts = [full[i : i + BLOCK] for i in range(0, len(full), BLOCK)]
            kept = [(b, self.tokens[self.width + i]) for i, b in enumerate(self.blocks)]
            own = [(p, sum(map(self.counts.__getitem__, p))) for p in parts]
            self._build([x for x in [*kept[:first], *own, *kept[last + 1 :]] if x[0]])
            return
        nodes = {self.width + i for i in range(first, last + 1)}
        for i in nodes:
            self._leaf(i - self.width, self.blocks[i - self.width])
        while nodes := {i // 2 for i in nodes if i > 1}:
            for i in nodes:
                self._sum(i)

    def _meet(self, changed: str, old: list[str], at: int, drop: int, put: int, ahead: int, ends: bool) -> tuple[list[str], list[str]] | None:
        """New pre-tokens up to where an old one starts too, and the old ones from there; None if there is no such place."""
        old_at, start = {}, 0
        for k, piece in enumerate(old):
            if start >= at + drop:
                old_at[start + put - drop] = k
            start += len(piece)
        new, start = [], 0
        for piece in pretokens(changed, self.counts.paths):
            if start >= at + put and start in old_at and (ends or start + ahead <= len(changed)):
                return new, old[old_at[start] :]
            new.append(piece)
            start += len(piece)
        return (new, []) if ends else None


def _plan(edits: list[dict] | None) -> list[tuple[int, int, str]]:
    return [(e["at"] or 0, e["drop"] or 0, e["put"] or "") for e in edits or [] if e is not None]


def _recount(text: str, edits: list[dict], counts: Counts) -> tuple[int, int, int, int, int]:
    """(tokens, tokens after the edits, pre-tokens encoded again, pre-tokens, characters after)."""
    tree = TokenTree(text, counts)
    n, pieces = tree.n_tokens, sum(map(len, tree.blocks))
    for at, drop, put in _plan(edits):
        tree.edit(at, drop, put)
    return n, tree.n_tokens, tree.encoded, pieces, tree.n_chars


def _count_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    counts = Counts(paths)
    names = ["n_tokens", "n_tokens_edited", "n_reencoded", "n_pretokens", "n_chars_edited"]
    for batch in batches:
        got = [_recount(t.as_py(), e.as_py(), counts) for t, e in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[i] for g in got], pa.int64()) for i in range(5)]], ["id", *names])


def count_with_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Token counts of each text before and after its edits.

    ``edits`` is an array of (at int, drop int, put string), applied in order, each to the text
    that the ones before it left.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), edits.alias("edits"))
    kind = src.schema["id"].dataType.simpleString()
    count = partial(_count_batches, paths=paths or tokens.vocabulary_paths())
    return src.mapInArrow(count, f"id {kind}, n_tokens bigint, n_tokens_edited bigint, n_reencoded bigint, n_pretokens bigint, n_chars_edited bigint")


BLOCKS = "array<struct<text: string, tokens: bigint>>"


def _rows(trees: list[TokenTree]) -> pa.Array:
    return pa.array([[{"text": t, "tokens": n} for t, n in tree.kept()] for tree in trees], pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int64())])))


def _tree_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    counts = Counts(paths)
    for batch in batches:
        trees = [TokenTree(t.as_py(), counts) for t in batch.column(1)]
        numbers = [[t.n_tokens for t in trees], [sum(map(len, t.blocks)) for t in trees], [t.n_chars for t in trees]]
        yield pa.RecordBatch.from_arrays([batch.column(0), _rows(trees), *[pa.array(x, pa.int64()) for x in numbers]], ["id", "blocks", "n_tokens", "n_pretokens", "n_chars"])


def _edit_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], keep: bool) -> Iterator[pa.RecordBatch]:
    counts = Counts(paths)
    for batch in batches:
        trees, before = [], []
        for blocks, edits in zip(batch.column(1), batch.column(2)):
            tree = TokenTree.stored([(b["text"], b["tokens"]) for b in blocks.as_py() or []], counts)
            before.append(tree.n_tokens)
            for at, drop, put in _plan(edits.as_py()):
                tree.edit(at, drop, put)
            trees.append(tree)
        numbers = [[t.n_tokens for t in trees], before, [t.encoded for t in trees], [t.n_chars for t in trees]]
        rows = [_rows(trees)] if keep else []
        yield pa.RecordBatch.from_arrays([batch.column(0), *rows, *[pa.array(x, pa.int64()) for x in numbers]], ["id", *["blocks"] * keep, "n_tokens", "n_tokens_before", "n_reencoded", "n_chars"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, blocks, n_tokens, n_pretokens, n_chars): the tree of each text, to be written and edited later."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, blocks {BLOCKS}, n_tokens bigint, n_pretokens bigint, n_chars bigint"
    return src.mapInArrow(partial(_tree_batches, paths=paths or tokens.vocabulary_paths()), schema)


def edit_stored(trees: DataFrame, edits: Column, paths: tuple[str, str] | None = None, keep: bool = True) -> DataFrame:
    """(id, blocks, n_tokens, n_tokens_before, n_reencoded, n_chars) of ``stored`` trees after a batch of edits; texts are not encoded again.

    Without ``keep`` the edited blocks are not given back.
    """
    src = trees.select("id", F.col("blocks").cast(BLOCKS).alias("blocks"), edits.alias("edits"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, {f'blocks {BLOCKS}, ' if keep else ''}n_tokens bigint, n_tokens_before bigint, n_reencoded bigint, n_chars bigint"
    return src.mapInArrow(partial(_edit_batches, paths=paths or tokens.vocabulary_paths(), keep=keep), schema)


def standard_edits(n: Column) -> Column:
    """Three edits of a text of n characters: a title put before it, some words amid it replaced, its last characters cut."""
    edit = lambda at, drop, put: F.struct(at.cast("int").alias("at"), F.lit(drop).alias("drop"), F.lit(put).alias("put"))
    return F.array(edit(F.lit(0), 0, "Second draft:\n"), edit(F.floor(n / 2), 40, " these words stand in for others "), edit(F.greatest(n - 10, F.lit(0)), 25, "."))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the tree of every document, apply the edits to the stored trees, and report both counts."""
    path = new_path(spark, "trees")
    stored(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    trees = spark.read.parquet(path)
    edited = edit_stored(trees.select(F.struct("id", "n_pretokens").alias("id"), "blocks", "n_chars"), standard_edits(F.col("n_chars")), keep=False)
    return edited.select(
        F.col("id.id").alias("doc_id"), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded",
        F.col("id.n_pretokens").alias("n_pretokens"), F.col("n_chars").alias("n_chars_edited"),
    )
