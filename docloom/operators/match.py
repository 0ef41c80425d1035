"""Text conditions as composable objects.

``all_of("machine", "learning") & phrase("deep", "nets").but_not(term("toy"))``
builds a tree. A tree gives a boolean column and the list of its positive
leaves, which are what ranking counts. Both are written against a *view* of a
document's words, so the same tree runs over token arrays (``TokenView``) and
over rows of the postings table (``PostingsView``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import query_tokens


class TokenView:
    """Words of a document as one array column."""

    def __init__(self, tokens):
        self.tokens = F.col(tokens) if isinstance(tokens, str) else tokens

    def has(self, leaf: Leaf) -> Column:
        every = [F.array_contains(self.tokens, w) for w in leaf.exact_words]
        if len(leaf.words) == 1 and not leaf.initial:
            return every[0] if every else F.exists(self.tokens, lambda t: t.startswith(leaf.words[0]))
        # cheap membership tests first, word order only where they pass
        return reduce(and_, [*every, self.count(leaf) > 0])

    def count(self, leaf: Leaf) -> Column:
        if leaf.initial:
            return F.when(self._at(leaf, F.get(self.tokens, F.lit(0)), F.lit(0)), 1).otherwise(0)
        if len(leaf.words) == 1 and not leaf.prefix:
            return F.size(self.tokens) - F.size(F.array_remove(self.tokens, leaf.words[0]))
        return F.size(F.filter(self.tokens, lambda t, i: self._at(leaf, t, i)))

    def starts(self, leaf: Leaf) -> Column:
        """0-based positions at which the leaf occurs."""
        if leaf.initial:
            none = F.array().cast("array<int>")
            return F.when(self.count(leaf) > 0, F.array(F.lit(0))).otherwise(none)
        at = F.transform(self.tokens, lambda t, i: F.when(self._at(leaf, t, i), i))
        return F.filter(at, lambda p: p.isNotNull())

    def _at(self, leaf: Leaf, word: Column, i: Column) -> Column:
        last = len(leaf.words) - 1

        def same(token, n):
            wanted = leaf.words[n]
            return token.startswith(wanted) if leaf.prefix and n == last else token == wanted

        rest = [same(F.get(self.tokens, i + n), n) for n in range(1, last + 1)]
        return F.coalesce(reduce(and_, rest, same(word, 0)), F.lit(False))


class PostingsView:
    """Words of a document as a map from word to its positions.

    The map holds the words the query asks about, not the whole document.
    """

    def __init__(self, occurrences):
        self.occurrences = F.col(occurrences) if isinstance(occurrences, str) else occurrences

    def has(self, leaf: Leaf) -> Column:
        return self.count(leaf) > 0

    def count(self, leaf: Leaf) -> Column:
        return F.size(self.starts(leaf))

    def starts(self, leaf: Leaf) -> Column:
        last = len(leaf.words) - 1
        found = None
        for n, word in enumerate(leaf.words):
            if leaf.prefix and n == last:
                at = F.flatten(F.map_values(F.map_filter(self.occurrences, lambda w, _: w.startswith(word))))
            else:
                at = F.coalesce(F.try_element_at(self.occurrences, F.lit(word)), F.array().cast("array<int>"))
            if n:
                shift = n
                at = F.transform(at, lambda p: p - F.lit(shift))
            found = at if found is None else F.array_intersect(found, at)
        return F.filter(found, lambda p: p == 0) if leaf.initial else found


class Match:
    """Base of all conditions. Combine with ``&``, ``|`` and ``but_not``."""

    def __and__(self, other: Match) -> Match:
        return AllOf([self, other])

    def __or__(self, other: Match) -> Match:
        return AnyOf([self, other])

    def but_not(self, other: Match) -> Match:
        return ButNot(self, other)

    def matches(self, view) -> Column:
        raise NotImplementedError

    def leaves(self) -> list[Leaf]:
        """Positive leaves in query order; a repeated leaf counts again."""
        raise NotImplementedError

    def all_leaves(self) -> list[Leaf]:
        """Also the excluded ones, for looking words up."""
        return self.leaves()


class Leaf(Match):
    """A word or a run of consecutive words.

    ``prefix`` lets the last word continue, ``initial`` asks for the start of
    the text.
    """

    def __init__(self, text, prefix=False, initial=False):
        self.words = query_tokens(text)
        if not self.words:
            raise ValueError(f"no word in {text!r}")
        self.prefix, self.initial = prefix, initial

    @property
    def exact_words(self):
        return self.words[:-1] if self.prefix else self.words

    def matches(self, view):
        return view.has(self)

    def leaves(self):
        return [self]


class AllOf(Match):
    def __init__(self, parts):
        self.parts = list(parts)

    def matches(self, view):
        return reduce(and_, (p.matches(view) for p in self.parts))

    def leaves(self):
        return [leaf for p in self.parts for leaf in p.leaves()]

    def all_leaves(self):
        return [leaf for p in self.parts for leaf in p.all_leaves()]


class AnyOf(AllOf):
    def matches(self, view):
        return reduce(or_, (p.matches(view) for p in self.parts))


class ButNot(Match):
    def __init__(self, keep, drop):
        self.keep, self.drop = keep, drop

    def matches(self, view):
        return self.keep.matches(view) & ~self.drop.matches(view)

    def leaves(self):
        return self.keep.leaves()

    def all_leaves(self):
        return self.keep.all_leaves() + self.drop.all_leaves()


class Near(AllOf):
    """Leaves with at most ``distance`` words between first and last."""

    def __init__(self, parts, distance=10):
        super().__init__(parts)
        self.distance = distance

    def matches(self, view):
        # One pass over the occurrences in text order, remembering where each
        # leaf was seen last: linear in the occurrences, however frequent.
        def seen_at(n, leaf):
            return F.transform(view.starts(leaf), lambda at: F.struct(at.alias("at"), F.lit(n).alias("leaf")))

        events = F.array_sort(F.concat(*(seen_at(n, p) for n, p in enumerate(self.parts))))
        reach = [len(p.words) + self.distance for p in self.parts]
        never = F.lit(-(2**30))
        start = F.struct(*(never.alias(f"p{n}") for n in range(len(reach))), F.lit(False).alias("hit"))

        def step(seen, event):
            last = [
                F.when(event["leaf"] == n, event["at"]).otherwise(seen[f"p{n}"]) for n in range(len(reach))
            ]
            close = reduce(and_, (last[n] >= event["at"] - reach[n] for n in range(len(reach))))
            return F.struct(*(p.alias(f"p{n}") for n, p in enumerate(last)), (seen["hit"] | close).alias("hit"))

        present = reduce(and_, (p.matches(view) for p in self.parts))
        return present & F.aggregate(events, start, step, lambda seen: seen["hit"])


def term(text) -> Match:
    """One word; text that holds several words is a phrase."""
    return Leaf(text)


def phrase(*words) -> Match:
    return Leaf(" ".join(words))


def prefix(text) -> Match:
    return Leaf(text, prefix=True)


def initial(text) -> Match:
    return Leaf(text, initial=True)


def all_of(*words) -> Match:
    return AllOf([w if isinstance(w, Match) else Leaf(w) for w in words])


def any_of(*words) -> Match:
    return AnyOf([w if isinstance(w, Match) else Leaf(w) for w in words])


def near(*words, distance=10) -> Match:
    return Near([w if isinstance(w, Match) else Leaf(w) for w in words], distance)
