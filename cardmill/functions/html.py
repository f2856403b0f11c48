"""Text out of HTML fragments, with built-in string functions only."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

# What is no text: comments, scripts and style sheets, tags. What is not closed goes on to the end, so that
# each character is looked at a few times at most. A tag starts with a letter, ``/``, ``!`` or ``?``.
NO_TEXT = r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<[a-z/!?][^>]*(?:>|$)"
COMMENT = "(?s)<!--.*?-->"

NUMBER = r"^(#[xX][0-9a-fA-F]+|#[0-9]+);?"
NAME = r"^([A-Za-z][A-Za-z0-9]*;)"
# Names that need no semicolon, the longest first.
SHORT_NAME = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"

# Elements without content, which no tag closes.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SCRIPT_START = "(?i)<(?:script|style)"
SCRIPT = r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)"
# An element closed by its own tag. A slash that ends an unquoted value is part of that.
SELF_CLOSED = r"""<([A-Za-z][A-Za-z0-9:-]*)(\s(?:[^<>]*[\s"'])?)?/>"""
TAG_START = r"(?=</?[A-Za-z])"
TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"
MOST_NESTED = 128  # elements nested deeper than this are read as siblings, so that a tag costs no more than that
BLOCK = 512  # tags that are folded together
# Marks of tags are characters from this one on, or a blank outside of what is looked for.
SIGN, OUTSIDE = 0x100, " "
BUCKETS = 256  # a map is searched from its start, so names are dealt into small ones


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def with_value(state: Column, value: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(state, value)`` with the value computed once. Unlike ``let`` this copies neither the state nor the result."""
    return F.aggregate(F.array(value), state, body)


def _without_comments(text: Column) -> Column:
    # After the last end of a comment none is closed, so there no search for an end has to run through the text.
    tail = F.substring_index(text, "-->", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, COMMENT, ""), tail)


def strip_tags(fragment: Column) -> Column:
    """The fragment without tags, comments, scripts and styles. White space is kept as it is."""
    bare = F.when(F.contains(fragment, F.lit("-->")), _without_comments(fragment)).otherwise(fragment)
    return F.when(F.contains(fragment, F.lit("<")), F.regexp_replace(bare, NO_TEXT, "")).otherwise(fragment)


def tags_from(page: Column, root_id: str) -> Column:
    """The page from the element with the id on, cut before each tag: an array of ``(html, name, closing)``.

    Comments, scripts and styles are left out. Null if there is no such element.
    """
    bare = F.when(F.contains(page, F.lit("-->")), _without_comments(page)).otherwise(page)
    root = rf"""(?i)(?=<[a-z][a-z0-9:-]*\s(?:[^<>]*\s)?id\s*=\s*["']?{re.escape(root_id)}["'\s>])"""
    # The blank in front lets the root be at the very start.
    body = F.get(F.split(F.concat(F.lit(" "), bare), root, 2), F.lit(1))

    def pieces(body: Column) -> Column:
        text = F.when(body.rlike(SCRIPT_START), F.regexp_replace(body, SCRIPT, "")).otherwise(body)
        return F.split(F.when(F.contains(body, F.lit("/>")), F.regexp_replace(text, SELF_CLOSED, "<$1$2></$1>")).otherwise(text), TAG_START)

    return F.transform(
        let(body, pieces),
        lambda t: F.struct(
            t.alias("html"), F.lower(F.regexp_extract(t, TAG_NAME, 1)).alias("name"), t.startswith("</").alias("closing")
        ),
    )


def nested_tags(tags: Column, path: Sequence[str] | None, name: str, child_of: str, within: str) -> Column:
    """The tags inside elements ``name``, in one fold over ``tags_from`` that carries the open elements.

    Wanted are those elements that stand at ``path`` below the root, child by child, or anywhere below it if that is None, but not in
    one another. The result is an array of ``(html, name, opens, starts, depth, child, within)``. ``starts`` marks the opening tag of a
    wanted element, at depth 0. ``depth`` is that of the element which a tag opens, or of the outermost one
    which it closes, so an element ends before the first later tag of its depth or less. ``child`` says whether the element around is
    a ``child_of``, ``within`` whether it or one around it is a ``within``.

    A closing tag closes all up to the nearest open element of its name, and nothing if there is none, so what is
    not closed ends with what is around it. The end of the document closes the root.
    """
    kinds = F.transform(tags, lambda t: F.concat(F.when(t["closing"], "/").otherwise(""), t["name"]))
    n_blocks = F.ceil(F.size(tags) / BLOCK).cast("int")
    numbers = F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0)))
    blocks = let(kinds, lambda kinds: F.transform(numbers, lambda b: F.slice(kinds, b * BLOCK + 1, F.lit(BLOCK))))
    root = F.concat(F.lit("/"), F.coalesce(F.get(tags, F.lit(0))["name"], F.lit("")), F.lit("/"))
    target = None if path is None else F.concat(root, F.lit("".join(f"{p}/" for p in path)))
    signs = F.array(*(F.lit(chr(SIGN + i)) for i in range(8 * (MOST_NESTED + 3))))

    def block(state: Column, kinds: Column) -> Column:
        """The marks of a block apart from those before, for a fold copies its state at every step."""
        start = F.struct(state["open"].alias("open"), state["size"].alias("size"), state["card"].alias("card"), F.lit("").alias("marks"))
        joined = lambda s: F.struct(
            s["open"].alias("open"), s["size"].alias("size"), s["card"].alias("card"), F.concat(state["marks"], s["marks"]).alias("marks")
        )
        return F.aggregate(kinds, start, step, joined)

    def step(state: Column, kind: Column) -> Column:
        return with_value(state, _after(state["open"], state["size"], kind), lambda state, after: put(state, kind, after))

    def put(state: Column, kind: Column, after: Column) -> Column:
        closing, size, held = kind.startswith("/"), after["size"], state["card"]
        pushed = size > state["size"]
        there = F.lit(True) if target is None else after["open"] == target
        starts = (held == 0) & pushed & (kind == name) & (size > 1) & there
        card = F.when((held > 0) & (size >= held), held).when(starts, size).otherwise(0)

        def mark(card: Column) -> Column:
            depth = size - card + F.when(pushed, 0).otherwise(1)
            flags = F.when(held == 0, 4).otherwise(0) + F.when(F.contains(state["open"], F.lit(f"/{within}/")), 2).otherwise(0)
            code = 8 * depth + flags + F.when(state["open"].endswith(f"/{child_of}/"), 1).otherwise(0)
            return F.when(card == 0, OUTSIDE).otherwise(F.get(signs, code))

        return with_value(
            state,
            card,
            lambda state, card: F.struct(
                after["open"].alias("open"), size.alias("size"), card.alias("card"), F.concat(state["marks"], mark(card)).alias("marks")
            ),
        )

    start = F.struct(F.lit("/").alias("open"), F.lit(-1).alias("size"), F.lit(0).alias("card"), F.lit("").alias("marks"))
    marks = F.split(F.aggregate(blocks, start, block, lambda state: state["marks"]), "")

    def item(tag: Column, mark: Column) -> Column:
        code = F.ascii(mark) - SIGN
        flag = lambda bit: F.getbit(code, F.lit(bit)) == 1
        return F.when(
            mark != OUTSIDE,
            F.struct(
                tag["html"].alias("html"),
                tag["name"].alias("name"),
                (~tag["closing"]).alias("opens"),
                flag(2).alias("starts"),
                F.shiftright(code, 3).alias("depth"),
                flag(0).alias("child"),
                flag(1).alias("within"),
            ),
        )

    return F.filter(F.zip_with(tags, marks, item), lambda t: t.isNotNull())


def _after(open_: Column, size: Column, kind: Column) -> Column:
    """The open elements, as ``/div/p/``, and their number after a tag. The first tag opens the root, whose end closes all for good."""
    name = F.ltrim(kind, F.lit("/"))
    entry = F.concat(F.lit("/"), name, F.lit("/"))
    opened = F.struct(F.concat(open_, kind, F.lit("/")).alias("open"), F.greatest(size + 1, F.lit(1)).alias("size"))
    same = F.struct(open_.alias("open"), size.alias("size"))
    none = F.struct(F.lit("/").alias("open"), F.lit(0).alias("size"))

    def closed(inner: Column) -> Column:
        """``inner`` is what is open within the element that is closed."""
        kept = F.substring(open_, F.lit(1), F.char_length(open_) - F.char_length(inner) - F.char_length(name) - 1)
        levels = F.char_length(inner) - F.char_length(F.replace(inner, F.lit("/"), F.lit("")))
        return F.struct(kept.alias("open"), (size - levels - 1).alias("size"))

    return (
        F.when(~kind.startswith("/"), F.when((size == 0) | (size >= MOST_NESTED) | kind.isin(*VOID), same).otherwise(opened))
        .when(F.contains(open_, entry), let(F.call_function("substring_index", open_, entry, F.lit(-1)), closed))
        .when(name.isin("body", "html"), none)
        .otherwise(same)
    )


def _named(name: Column) -> Column:
    """The text of a name of HTML 5, or null."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for key, value in html5.items():
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return literal[(F.crc32(name) % BUCKETS).cast("int")][name]


def _replaced(code: int) -> str:
    """What a number stands for, where that is not its character."""
    if code == 0:
        return REPLACEMENT
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return "" if code < 0x20 and chr(code) not in "\t\n\f\r" or code in (0x0B, 0x7F) else chr(code)


def _numbered(reference: Column) -> Column:
    """``#233`` or ``#xE9`` as one character; what is no character becomes U+FFFD, or nothing."""
    low = F.array(*(F.lit(_replaced(c)) for c in range(0xA0)))

    def value(short: Column) -> Column:
        number = F.when(reference.rlike("^#[xX]"), F.conv(short, 16, 10)).otherwise(short)
        return F.when(F.length(short) > 9, 0x110000).when(short == "", 0).otherwise(number.cast("long"))

    def character(code: Column) -> Column:
        valid = ((code >= 0xA0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        unassigned = code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
        known = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(ord(REPLACEMENT))), 8, "0")), "UTF-32")
        return F.when(code < 0xA0, F.get(low, code.cast("int"))).when(valid & unassigned, "").otherwise(known)

    digits = F.regexp_extract(reference, r"([0-9a-fA-F]+)$", 1)
    return let(let(F.ltrim(digits, F.lit("0")), value), character)


def decode_entities(text: Column) -> Column:
    """Each character reference decoded once, so ``&amp;lt;`` gives ``&lt;``.

    The text is cut at every ``&``. A piece that starts with a number or a name is replaced,
    the longest known name first; old names need no semicolon. Any other piece keeps its ``&``.
    """

    def read(part: Column) -> Column:
        """What a piece may start with, each looked for once, and only after what comes before it."""
        first = F.substring(part, 1, 1)
        digits = F.when(first == "#", F.regexp_extract(part, NUMBER, 0)).otherwise("")
        name = F.when(first.between("A", "z"), F.regexp_extract(part, NAME, 1)).otherwise("")
        return F.struct(part.alias("part"), digits.alias("digits"), name.alias("name"), _named(name).alias("named"))

    def decode(piece: Column, index: Column) -> Column:
        part, digits, name = piece["part"], piece["digits"], piece["name"]
        after = lambda matched: F.substring(part, F.length(matched) + 1, F.length(part))
        short = let(
            F.regexp_extract(part, SHORT_NAME, 1),
            lambda s: F.when(s != "", F.concat(_named(s), after(s))).otherwise(F.concat(F.lit("&"), part)),
        )
        return (
            F.when(index == 0, part)
            .when(digits != "", F.concat(let(F.rtrim(digits, F.lit(";")), _numbered), after(digits)))
            .when(piece["named"].isNotNull(), F.concat(piece["named"], after(name)))
            .otherwise(short)
        )

    decoded = F.array_join(F.transform(F.transform(F.split(text, "&"), read), decode), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, quoted or not, entities decoded; empty if absent."""
    pattern = rf"""(?is)^[^>]*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


    def bare(found: Column) -> Column:
        quoted = F.substring(found, 1, 1).isin('"', "'")
        return F.when(quoted, F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)

    return let(let(F.regexp_extract(tag, pattern, 1), bare), decode_entities)
