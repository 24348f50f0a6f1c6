"""Byte-pair token columns: count, first and last tokens of a text, by the ranks of a given file.

The file is read where the plan is built and travels with the column, so executors need
no copy of it.  Texts are encoded whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from paperloom import kernels

# The public split pattern of byte-level vocabularies of 50,000 ranks.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

UNIT = "struct<section:int,paragraph:int,kind:int,size:int,text:string>"


class BytePairTokens:
    """The tokenizer of a chunker or a query; ``path`` names a rank file."""

    def __init__(self, path: str, pattern: str = BYTE_LEVEL_PATTERN):
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern

    def _column(self, work: Callable, returns: str, column: Column) -> Column:
        return kernels.token_udf(self.ranks, self.pattern, work, returns)(column)

    def count(self, text: Column) -> Column:
        """Tokens of a text; null and empty texts have none."""
        return self._column(lambda t, text: t.count(text), "int", text)

    def head(self, text: Column, n: int) -> Column:
        return self._column(lambda t, text: t.head(text, n), "string", text)

    def tail(self, text: Column, n: int) -> Column:
        """The last ``n`` tokens as text, the whole text when it has no more."""
        return self._column(lambda t, text: t.tail(text, n), "string", text)

    def ends(self, text: Column, first: int, last: int) -> Column:
        """``n, head, tail`` of a text: ``count``, ``head`` and ``tail`` by one worker and one encoding."""
        return self._column(lambda t, text: t.ends(text, first, last), "struct<n:int,head:string,tail:string>", text)

    def counts(self, texts: Column) -> Column:
        return self._column(lambda t, texts: [t.count(x) for x in texts], "array<int>", texts)

    def heads(self, texts: Column, n: int) -> Column:
        return self._column(lambda t, texts: [t.head(x, n) for x in texts], "array<string>", texts)

    def tails(self, texts: Column, n: int) -> Column:
        return self._column(lambda t, texts: [t.tail(x, n) for x in texts], "array<string>", texts)

    def units(self, paragraphs: Column, limit: int) -> Column:
        """Sized paragraphs, or sentences of longer ones, of a list of sections' paragraphs."""
        return self._column(lambda t, sections: t.units(sections, limit), f"array<{UNIT}>", paragraphs)
