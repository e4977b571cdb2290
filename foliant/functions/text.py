"""Text expressions: stripping, chunk boundaries, embedding input, deep links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space. Written out because an
# explicit class is many times faster than a Unicode-aware \s.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SENTENCE_GAP = rf"(?<=[.!?]){SPACE}+"


def strip(text: Column | str) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column | str) -> Column:
    """True for NULL, empty or white-space-only text."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def none_if_empty(text: Column | str) -> Column:
    return F.nullif(text if isinstance(text, Column) else F.col(text), F.lit(""))


def check_window(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")


def char_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of overlapping character chunks; a text of at most ``size`` is one chunk, '' is none.

    The text is cut once into pieces of ``size - overlap`` characters and a
    chunk is glued from the pieces it spans. Taking substrings at growing
    offsets would read a long text once per chunk.
    """
    check_window(size, overlap)
    step = size - overlap
    span = -(-size // step)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def glue(all_pieces: Column) -> Column:
        joined = lambda i: F.array_join(F.slice(all_pieces, i + 1, F.lit(span)), "")
        return F.transform(all_pieces, lambda _, i: F.substring(joined(i), 1, size))

    # Through a one-element array, so that the pieces are found once per text.
    chunks = F.get(F.transform(F.array(pieces), glue), F.lit(0))
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(text))
        .otherwise(chunks)
    )


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences, split after . ! ? followed by space."""
    pieces = F.transform(F.split(text, SENTENCE_GAP), strip)
    return F.filter(pieces, lambda s: s != "")


def sentence_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks packed from whole sentences, as one fold over the sentence array.

    A sentence counts its length plus one. When the next sentence would not
    fit, the chunk is closed and its last sentences, up to ``overlap``, open
    the next one. A sentence longer than ``size`` closes the chunk, is split by
    characters and carries nothing over.
    """
    check_window(size, overlap)
    state = "struct<done:array<string>,open:array<string>,used:int>"
    empty = F.array().cast("array<string>")

    def make(done: Column, open_: Column, used: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), used.cast("int").alias("used")).cast(state)

    def cost(s: Column) -> Column:
        return F.length(s) + 1

    def closed(acc: Column) -> Column:
        chunk = F.array(F.array_join(acc["open"], " "))
        return F.concat(acc["done"], F.when(F.size(acc["open"]) > 0, chunk).otherwise(empty))

    def tail(open_: Column) -> Column:
        """How many closing sentences fit in the overlap."""
        fits = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(open_), F.lit(1))),
            lambda k: F.aggregate(
                F.slice(open_, F.greatest(F.size(open_) - k + 1, F.lit(1)), k),
                F.lit(0),
                lambda total, s: total + cost(s),
            )
            <= overlap,
        )
        return F.least(F.size(fits), F.size(open_))

    def carried(open_: Column) -> Column:
        kept = tail(open_)
        return F.when(
            kept > 0, F.slice(open_, F.greatest(F.size(open_) - kept + 1, F.lit(1)), kept)
        ).otherwise(empty)

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda t, s: t + cost(s))

    def step(acc: Column, s: Column) -> Column:
        keep = carried(acc["open"])
        return (
            F.when(
                F.length(s) > size,
                make(F.concat(closed(acc), char_chunks(s, size, overlap)), empty, F.lit(0)),
            )
            .when(
                (F.size(acc["open"]) > 0) & (acc["used"] + cost(s) > size),
                make(closed(acc), F.concat(keep, F.array(s)), total(keep) + cost(s)),
            )
            .otherwise(make(acc["done"], F.concat(acc["open"], F.array(s)), acc["used"] + cost(s)))
        )

    packed = F.aggregate(sentences(text), make(empty, empty, F.lit(0)), step, closed)
    return (
        F.when(F.length(text) == 0, empty)
        .when(F.length(text) <= size, F.array(text))
        .otherwise(packed)
    )


def embed_prefix(
    title: Column, document_type: Column, correspondent: Column, tags: Column, custom_fields: Column
) -> Column:
    """Metadata header put in front of every chunk before embedding; '' when nothing is known."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(F.length(value) > 0, F.lit(False)), F.concat(F.lit(label), value))

    named = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(t != "", F.lit(False)))
    fields = F.filter(F.map_entries(custom_fields), lambda e: ~blank(e["value"]))
    lines = F.concat(
        F.array(
            line("Title: ", title),
            line("Type: ", document_type),
            line("From: ", correspondent),
            F.when(F.size(named) > 0, F.concat(F.lit("Tags: "), F.array_join(named, ", "))),
        ),
        F.coalesce(
            F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
            F.array().cast("array<string>"),
        ),
    )
    kept = F.array_compact(lines)
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))


def entity_text(entity_type: Column, name: Column, description: Column, limit: int = 2000) -> Column:
    """Text embedded for an entity: ``type: name`` and its description, cut at ``limit``."""
    extra = F.when(F.coalesce(description != "", F.lit(False)), F.concat(F.lit("\n"), description))
    return F.substring(
        F.concat(entity_type, F.lit(": "), name, F.coalesce(extra, F.lit(""))), 1, limit
    )


def deeplink(base: Column | str, document_id: Column | str) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/documents/"), document_id, F.lit("/details"))


def public_link(url: Column, internal: str, public: str) -> Column:
    """Swap the internal base for the public one when the url starts with it."""
    internal, public = internal.rstrip("/"), public.rstrip("/")
    if not internal or not public:
        return url
    rest = F.substring(url, F.lit(len(internal) + 1), F.length(url))
    return F.when(F.startswith(url, F.lit(internal)), F.concat(F.lit(public), rest)).otherwise(url)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic stand-in embedder: SHA-256 bytes / 255, repeated to ``dims`` values."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)

    def values(hexes: Column) -> Column:
        byte = lambda i: F.conv(F.substring(hexes, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10)
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i).cast("double") / 255)

    # Through a one-element array, so that the digest is computed once per row.
    return F.get(F.transform(F.array(digest), values), F.lit(0))
