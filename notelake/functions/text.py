"""Text functions as column expressions. All run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the note model: word lists, limits and constants.
KEYWORD_STOP_WORDS = (
    "this", "that", "with", "from", "into", "able", "should", "later", "before", "after",
    "their", "there", "these", "those", "and", "the", "for", "一个", "可以", "通过", "内容",
)
ENTITY_STOP_WORDS = (*KEYWORD_STOP_WORDS, "自己", "然后", "最后", "主要", "因为", "这个", "那个")
AMBIGUOUS_WORDS = ("这个", "那个", "这", "那", "不清楚", "模糊", "补充", "看看", "总结")
SOURCE_TYPES = {
    "txt": "text", "md": "markdown", "markdown": "markdown", "json": "json", "csv": "csv", "html": "html",
    "htm": "html", "xml": "xml", "log": "text", "png": "image", "jpg": "image", "jpeg": "image",
    "webp": "image", "gif": "image", "pdf": "pdf", "mp3": "audio", "wav": "audio", "m4a": "audio",
    "mp4": "video", "mov": "video", "mkv": "video",
}
#: What counts as white space: \s of Java in its Unicode sense, and the byte order mark.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CHUNK_CHARS, EARLY_CHARS = 900, 1_500
VECTOR_BINS = 384


def text_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def normalized(c: Column) -> Column:
    """Line ends to line feeds, runs of blanks and tabs to one blank, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"[ \t]+", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(normalized(c), rf"(?<=[.!?。！？]){SPACE}+"), trimmed), lambda s: s != "")


def summary(c: Column) -> Column:
    """The first sentence of 40 characters, or the first, or the text's start; 220 characters at most.

    Of a long text the start is looked at first: its sentences but the last are the text's own.
    """
    long_enough = lambda found: F.get(F.filter(found, lambda s: F.length(s) >= 40), F.lit(0))
    early = F.when(F.length(c) > EARLY_CHARS, bound(sentences(F.substring(c, 1, EARLY_CHARS)), lambda found: long_enough(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))))
    first = bound(sentences(c), lambda found: F.coalesce(long_enough(found), F.get(found, F.lit(0))))
    whole = F.coalesce(early, first, F.substring(c, 1, 180))
    return bound(whole, lambda s: F.when(F.length(s) > 220, F.concat(F.substring(s, 1, 217), F.lit("..."))).otherwise(s))


def title(summary_: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(summary_, rf"[^\p{{L}}\p{{N}}\-{SPACE[1:-1]}]", ""), f"{SPACE}+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 8), " "), F.lit("")), F.lit("Untitled note"))


def search_query(title_: Column, text: Column) -> Column:
    """What to ask the web about a capture: its first 260 characters, and its title unless that looks made up."""
    said = F.substring(trimmed(F.regexp_replace(text_of(text), f"{SPACE}+", " ")), 1, 260)
    named = trimmed(text_of(title_))
    return F.array_join(F.filter(F.array(said, F.when(named.rlike("(?i)验证|test|mock|demo|示例"), "").otherwise(named)), lambda x: x != ""), " ")


def resource_address(c: Column) -> Column:
    """A resource as exports write it: addresses as they are, paths with slashes, relative to the folder."""
    slashed = F.replace(text_of(c), F.lit("\\"), F.lit("/"))
    absolute = slashed.rlike("^([A-Za-z]:)?/")
    return F.when(text_of(c).rlike("(?i)^(https?|file):") | (text_of(c) == "inline-input"), text_of(c)).when(absolute, F.concat(F.lit("file:///"), slashed)).when(slashed.startswith("."), slashed).otherwise(F.concat(F.lit("./"), slashed))


def object_title(title_: Column, name: Column, resource: Column, id_: Column) -> Column:
    """What an object is called: the first of these that says something."""
    return F.coalesce(*[F.nullif(text_of(c), F.lit("")) for c in (title_, name, resource)], id_)


def slug(title_: Column, text: Column) -> Column:
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title_), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, 70)
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("note")), F.lit("-"), F.substring(F.sha1(F.concat(title_, F.lit("\n"), text).cast("binary")), 1, 8))


def normalized_id(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, 96), F.lit("")), F.lit("unknown"))


def is_keyword(token: Column) -> Column:
    return (F.length(token) >= 3) & ~token.isin(*KEYWORD_STOP_WORDS)


def open_questions(c: Column) -> Column:
    return F.slice(F.filter(sentences(c), lambda s: s.rlike("[?？]$")), 1, 5)


def is_ambiguous(c: Column) -> Column:
    text = normalized(c)
    return (F.length(text) < 80) | text.isin(*AMBIGUOUS_WORDS)


def extension(c: Column) -> Column:
    """The file name's extension in a path or address, without the dot."""
    name = F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def source_type(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension(c)), F.lit("text"))


def resource_type(c: Column) -> Column:
    """What a note's resource is, by its extension or as an address; "unknown" else."""
    kind = source_type(c)
    return F.when(kind.isin("video", "audio", "image", "pdf") & (extension(c) != "gif"), kind).when(c.rlike("(?i)^https?:"), "url").otherwise("unknown")


def without_markup(c: Column) -> Column:
    for pattern, by in (
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"</?[^>]+>", " "),
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return normalized(c)


def html_title(c: Column) -> Column:
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    return F.when(c.rlike(pattern), without_markup(F.regexp_extract(c, pattern, 1)))


_JSON_TITLES = ("title", "topic", "name", "headline", "subject")


def json_text(c: Column) -> Column:
    """The fields of a JSON object as "key: value", joined by full stops; the text itself if it is none."""
    fields = F.map_entries(F.from_json(c, "map<string,string>"))
    value = lambda e: F.coalesce(F.when(e["value"].rlike(r"(?s)^\[.*\]$"), F.array_join(F.from_json(e["value"], "array<string>"), ", ", "null")), e["value"], F.lit("null"))
    said = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(value(e), "[.。]+$", ""))), ". ")
    return F.coalesce(said, normalized(c))


def json_title(c: Column) -> Column:
    """The first of a JSON object's usual title fields that holds a text; null without one."""
    fields = F.from_json(c, "map<string,string>")
    text = lambda k: F.when(F.get_json_object(c, f"$.{k}").isNotNull() & c.rlike(rf'"{k}"\s*:\s*"'), F.nullif(trimmed(F.element_at(fields, k)), F.lit("")))
    return F.coalesce(*[text(k) for k in _JSON_TITLES])


def json_note(c: Column, name: Column, pretty: Column) -> Column:
    """A JSON capture as text: its title (or the file's name), its fields, and the document itself as ``pretty`` shows it."""
    made = F.concat(F.coalesce(json_title(c), name), F.lit(". "), json_text(c), F.lit("\n\nRaw JSON:\n"), pretty)
    return F.when(F.from_json(c, "map<string,string>").isNull() | pretty.isNull(), normalized(c)).otherwise(made)


def salvaged_json(c: Column) -> Column:
    """The JSON object that a tool printed last: from the last opening to the last closing brace; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{[^{]*\})[^}]*\z", 1), F.lit(""))


def first_lines(c: Column, n: int = 40) -> Column:
    return F.slice(F.filter(F.split(normalized(c), "\n"), lambda line: line != ""), 1, n)


def chunks(c: Column) -> Column:
    """The body in pieces of 900 characters, white space collapsed; none for a blank body."""

    def cut(body: Column) -> Column:
        n = F.ceil(F.length(body) / CHUNK_CHARS).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(body, i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)))
        return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))

    return bound(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), cut)


def note_chunks(title_: Column, description: Column, tags: Column, body: Column) -> Column:
    """A note's chunks: the first is of its title, description and tags, unless these are blank; then those of its body."""
    head = F.concat_ws("\n", text_of(title_), text_of(description), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    first = F.when(trimmed(head) != "", head)
    return F.concat(F.array(F.struct(F.lit(0).alias("chunk_no"), first.alias("chunk"))), F.transform(chunks(body), lambda x, i: F.struct((i + 1).alias("chunk_no"), x.alias("chunk"))))


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash over the characters' numbers."""
    return F.aggregate(F.filter(F.split(c, ""), lambda ch: ch != ""), F.lit(2166136261).cast("long"), lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


#: Latin letters with diacritics and the letters that full-text search takes them for, by their decomposition.
_MARKED = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if (d := unicodedata.normalize("NFD", c)) != c and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]


def folded(c: Column) -> Column:
    """Letters without their diacritics, as full-text search compares them."""
    return F.translate(c, "".join(_MARKED), "".join(unicodedata.normalize("NFD", x)[0] for x in _MARKED))


def han_parts(token: Column) -> Column:
    """The runs of two and of three characters of a token of three or more that has a Han character; none of others."""
    run = lambda k: F.transform(F.sequence(F.lit(1), F.length(token) - (k - 1)), lambda i: F.substring(token, i, F.lit(k)))
    return F.when((F.length(token) > 2) & token.rlike(r"\p{IsHan}"), F.concat(run(2), run(3))).otherwise(F.array().cast("array<string>"))


def expanded_tokens(c: Column) -> Column:
    """What a hashed vector counts: tokens, the parts of those with Han characters, and pairs of neighbours."""
    return bound(tokens(c), lambda t: F.concat(t, F.flatten(F.transform(t, han_parts)), word_pairs(t)))


def snippet(c: Column, wanted: Column, n: int = 18) -> Column:
    """``n`` words of a text from the first one on that folds to one of ``wanted``; the text's start without one."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)

    def cut(t: Column) -> Column:
        hits = F.filter(F.transform(t, lambda w, i: F.when(F.array_contains(wanted, folded(F.lower(w))), i)), lambda i: i.isNotNull())
        at = F.coalesce(F.get(hits, F.lit(0)), F.lit(0))
        said = F.array_join(F.slice(t, at + 1, F.lit(n)), " ")
        return F.concat(F.when(at > 0, "...").otherwise(""), said, F.when(F.size(t) > at + n, "...").otherwise(""))

    return bound(words, cut)


def word_pairs(toks: Column) -> Column:
    return F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b))


def token_weight(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("_")), F.lit(1.4)).when(F.length(token) >= 6, F.lit(1.2)).otherwise(F.lit(1.0))


def linked_as_markdown(c: Column) -> Column:
    """[[target|label]] and [[target]] as Markdown links."""
    c = F.regexp_replace(c, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2]($1.md)")
    return F.regexp_replace(c, r"\[\[([^\]|]+)\]\]", "[$1]($1.md)")
