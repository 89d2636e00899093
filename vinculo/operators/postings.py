"""Positional postings of page texts: words and names are found by positions, not by reading pages.

The index holds every distinct token of a page with its places. A name's word
has no blank, so each of its occurrences in a text lies inside one token, and
which tokens hold it is settled on the dictionary. An occurrence is one number:
four times its place, plus 2 if it starts a token, plus 1 if it ends one. Order,
distance and whole phrases are then arithmetic on short arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import let
from ..functions.positions import token_positions
from .blocking import words_inside_tokens
from .scale import store


def positional_index(pages: DataFrame) -> DataFrame:
    """(page_ord, token, at) of pages (page_ord, norm), stored in the order of tokens so that blocks of rows compress and can be skipped."""
    found = pages.select("page_ord", "norm").mapInArrow(token_positions, "page_ord long, token string, at array<int>")
    return store(found.sortWithinPartitions("token", "page_ord"), "positions")


def vocabulary_of(index: DataFrame) -> DataFrame:
    """(token, df), stored."""
    return store(index.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "vocabulary")


@dataclass
class WordPostings:
    #: (word, page_ord, at): all occurrences of a word on a page, ascending, as numbers described above.
    rows: DataFrame
    #: (word, load): pages that the word's tokens are on, at most.
    load: DataFrame


def word_postings(words: DataFrame, index: DataFrame, vocabulary: DataFrame) -> WordPostings:
    """Postings of ``words(word)`` of three letters or more, stored."""
    inside = words_inside_tokens(words, vocabulary)
    length = F.length("word")
    spots = F.filter(F.sequence(F.lit(0), F.length("token") - length), lambda i: F.substring("token", i + 1, length) == F.col("word"))
    mark = lambda i: i * 4 + F.when(i == 0, 2).otherwise(0) + F.when(i + length == F.length("token"), 1).otherwise(0)
    inside = store(inside.select("word", "token", "df", F.transform(spots, mark).alias("spots")), "inside")
    each = index.join(inside.select("word", "token", "spots"), "token")
    at = F.flatten(F.transform("at", lambda p: F.transform("spots", lambda s: p * 4 + s)))
    rows = each.select("word", "page_ord", at.alias("at")).groupBy("word", "page_ord").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    return WordPostings(store(rows, "word-postings"), store(inside.groupBy("word").agg(F.sum("df").alias("load")), "word-loads"))


def place(occurrence: Column) -> Column:
    return F.shiftright(occurrence, 2)


def first_place(at: Column) -> Column:
    return place(F.get(at, F.lit(0)))


def stands_whole(at: Column) -> Column:
    """Whether the word is a token of the page."""
    return F.exists(at, lambda p: p.bitwiseAND(F.lit(3)) == 3)


def word_offsets(norm: Column) -> Column:
    """Places of a folded name's words of three letters or more, from 0."""
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, word: Column) -> Column:
        at = F.when(F.length(word) >= 3, F.concat(state["at"], F.array(state["next"]))).otherwise(state["at"])
        return F.struct((state["next"] + F.length(word) + 1).alias("next"), at.alias("at"))

    return F.aggregate(F.split(norm, " "), start, step, lambda s: s["at"])


def at_distance(left: Column, right: Column, distance: Column) -> Column:
    """Whether some occurrences of two words lie as far apart as in the name. Places meet as sets, not pair by pair."""
    return F.arrays_overlap(F.transform(left, lambda p: place(p) + distance), F.transform(right, place))


def in_order(ats: Column, words: Column) -> Column:
    """J-4: every word is found behind the one before it, each as early as possible."""

    def step(behind: Column, k: Column) -> Column:
        here = F.get(F.filter(F.get(ats, k), lambda p: place(p) >= behind), F.lit(0))
        return F.when(behind <= 0, behind).otherwise(F.coalesce(place(here) + F.length(F.get(words, k)), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), F.lit(1), step) > 0


def phrase_start(ats: Column, offsets: Column) -> Column:
    """First occurrence of the first word behind which the others follow as in the name, inner ends being token ends; else NULL.

    Every word says at which places the name would start; what all of them say
    is an intersection of sets, so a page with very many occurrences costs their number.
    """
    last = F.size(offsets) - 1

    def starts_by(k: Column) -> Column:
        inner = F.when(k > 0, 2).otherwise(0) + F.when(k < last, 1).otherwise(0)
        fitting = F.filter(F.get(ats, k), lambda q: q.bitwiseAND(inner) == inner)
        return F.transform(fitting, lambda q: place(q) - (F.get(offsets, k) - F.get(offsets, F.lit(0))))

    starts = F.aggregate(F.sequence(F.lit(0), last), F.transform(F.get(ats, F.lit(0)), place), lambda some, k: F.array_intersect(some, starts_by(k)))
    return let(F.get(starts, F.lit(0)), lambda start: F.get(F.filter(F.get(ats, F.lit(0)), lambda p: place(p) == start), F.lit(0)))
