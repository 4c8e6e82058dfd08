"""Text cleaning as column expressions: everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed, closing phrases, reply and signature marks, and footer keywords.
INVISIBLE = "‌‍͏­​﻿"
CLOSERS = (
    "best regards", "kind regards", "warm regards", "regards,", "cheers,", "thanks,", "thank you,", "sincerely,",
    "sent from my iphone", "sent from my ipad", "sent from my android",
)
REPLY_MARKS = (r"On .{0,200} wrote:\s*$", r"-----Original Message-----$", r"----- Forwarded message -----$", r"Begin forwarded message:\s*$", r"From:\s+.+")
FOOTER_KEYWORDS = (
    "unsubscribe", "manage preferences", "privacy policy", "confidential", "privileged", "intended recipient",
    "this message may contain", "do not distribute", "do not share",
)
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))

_BLANKS = r"[ \t\n\x0B\f\r\u001C-\u001F\u0085   -     　]"


#: The same characters as a string, and those that stand inside a line.
_BLANK_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_INNER = _BLANKS.replace(r"\n", "")


def strip(col: Column, which: str = "both") -> Column:
    """Without white space at the ends, the non-ASCII kinds included; what lies between isn't looked at."""
    return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[which](col, F.lit(_BLANK_CHARS))


def lines(col: Column) -> Column:
    """The lines of a text; one trailing line break opens no further line."""
    return F.split(F.regexp_replace(col, r"\n\z", ""), "\n")


def joined(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def _bare_ends(text: Column, blank: str) -> Column:
    """Lines without blanks before their breaks; only a text with such a blank is searched run by run, each run once."""
    return F.when(text.rlike(rf"\n(?<={blank}\n)"), F.regexp_replace(text, rf"(?={blank})(?<!{blank}){blank}++(?=\n)", "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Scripts and styles go (to the end of the text if unclosed), each tag is a line break, six entities are decoded."""
    out = html
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}.*?(</{tag}>|\z)", "")
    out = F.regexp_replace(out, "<[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*\z", "")
    out = F.replace(out, F.lit(">"), F.lit(""))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return normalize_body(out)


def normalize_body(body: Column) -> Column:
    """Line breaks as \\n, lines right-trimmed, quoted From lines restored, at most two blank lines in a row, trimmed."""
    out = F.regexp_replace(body, "\r\n?", "\n")
    out = F.regexp_replace(_bound(out, lambda text: _bare_ends(text, r"[ \t\x0B\f\r\u00A0]")), r">(?<![^\n]>)From ", "From ")
    return strip(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


#: What every boilerplate line holds.
_BOILERPLATE = r"(?i)unsubscr[i\u0130]be|browser|trouble"


def clean_text(body: Column) -> Column:
    """Invisible characters and the usual mailing boilerplate lines go; lines are trimmed; at most two blank lines stay."""

    def boilerplate(line: Column) -> Column:
        low = F.lower(F.replace(line, F.lit("\u0130"), F.lit("i")))
        view = low.contains("browser") & any_of([low.contains(p) for p in ("view this email", "view in browser", "view this message")])
        trouble = low.contains("trouble") & any_of([low.contains(p) for p in ("viewing", "displaying", "reading")])
        return low.contains("unsubscribe") | view | trouble

    def kept(text: Column) -> Column:  # only a text that may have such a line is taken apart
        return F.when(text.rlike(_BOILERPLATE), joined(F.filter(F.split(text, "\n"), lambda line: ~boilerplate(line)))).otherwise(text)

    seen = F.regexp_replace(body, rf"[[^\x00-\x7F]&&[{INVISIBLE}]]", "")
    out = F.regexp_replace(_bound(seen, kept), rf"\n{_INNER}++", "\n")
    out = _bound(out, lambda text: _bare_ends(text, _INNER))
    return strip(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


def _head(parts: Column, n: Column) -> Column:
    """The first n lines joined and right-trimmed."""
    return strip(joined(F.slice(parts, F.lit(1), n)), "right")


def _places(parts: Column, test) -> Column:
    """1-based places of the lines that pass test(line, place)."""
    marked = F.transform(parts, lambda line, i: F.when(test(line, i + 1), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def _cut_at(parts: Column, place: Column, otherwise: Column) -> Column:
    """The lines before a place (from 1) joined and right-trimmed; otherwise where the place is null."""
    return _bound(place, lambda at: F.when(at.isNull(), otherwise).otherwise(_head(parts, F.coalesce(at - 1, F.lit(0)))))


def _line(*patterns: str) -> str:
    """One pattern for a line that, without blanks at its ends, matches any of the patterns."""
    return f"(?i)^{_BLANKS}*(?:{'|'.join(patterns)})"


_RULES = _line(rf"(?:[_-]{{3,}}|--|—){_BLANKS}*$")
_CLOSERS = _line(*(c.replace("k", r"[k\u212A]").replace("i", r"[i\u0130]") for c in CLOSERS))  # their lower case is ASCII
_CLOSER_LINE = _CLOSERS.replace("^", r"\n").replace(_BLANKS, _INNER)  # both in a text with a line break before it
_FROM_RULE = rf"(?s)\n{_INNER}*+(?:[_-]{{3,}}+|--|—){_INNER}*+(?:\n.*+)?\z"
_REPLIES = _line(*(m.replace(r"\s*$", "$").replace("$", f"{_BLANKS}*$") if m.endswith("$") else rf"From:\s+.*(?!{_BLANKS})." for m in REPLY_MARKS))
_SIGNATURES = _line(rf"(?:--|__+){_BLANKS}*$", "sent from my")
_FOOTERS = "(?i)" + "|".join(FOOTER_KEYWORDS)


def remove_signature(body: Column) -> Column:
    """Cut at a signature mark, or past four fifths of the lines at a closing phrase, if any text stands before; a text that
    has neither stays as it is. All lines count, the empty one after a last line break too."""

    def cut(parts: Column, text: Column) -> Column:
        late = F.size(parts) * 8
        first = F.array_min(_places(parts, lambda line, i: line.rlike(_RULES) | (((i - 1) * 10 > late) & line.rlike(_CLOSERS))))
        return _cut_at(parts, first, text)

    def own(text: Column) -> Column:  # only a text with a closing phrase at the start of a line has its lines counted
        by_line = _bound(F.split(text, "\n"), lambda parts: cut(parts, text))
        broken = F.concat(F.lit("\n"), text)
        kept = F.when(broken.rlike(_CLOSER_LINE), by_line).otherwise(F.substring(F.regexp_replace(broken, _FROM_RULE, ""), 2, 2**31 - 1))
        return _bound(kept, lambda k: F.when(k == text, text).otherwise(_bound(strip(k), lambda t: F.when(t == "", text).otherwise(t))))

    return _bound(body, own)


def strip_reply_chain(body: Column) -> Column:
    """Cut at the first line that opens a quoted message; then trailing quoted lines go."""

    def own(kept: Column) -> Column:
        return _head(kept, F.coalesce(F.array_max(_places(kept, lambda line, _: ~line.rlike(f"^{_BLANKS}*>"))), F.lit(0)))

    def cut(parts: Column) -> Column:
        first = F.array_min(_places(parts, lambda line, _: line.rlike(_REPLIES)))
        return _bound(_bound(first, lambda at: F.when(at.isNull(), parts).otherwise(F.slice(parts, F.lit(1), F.coalesce(at - 1, F.lit(0))))), own)

    return _bound(F.split(body, "\n"), cut)


def strip_signature(body: Column) -> Column:
    """Cut at the first line that is a signature mark or says which device sent it."""
    return _bound(F.split(body, "\n"), lambda parts: _cut_at(parts, F.array_min(_places(parts, lambda line, _: line.rlike(_SIGNATURES))), body))


def strip_footer(body: Column) -> Column:
    """Cut at the lowest keyword line within the last third."""

    def cut(parts: Column) -> Column:
        low = F.floor(F.size(parts) * 0.66).cast("int")
        return _cut_at(parts, F.array_max(_places(parts, lambda line, i: (i > low) & line.rlike(_FOOTERS))), body)

    return _bound(F.split(body, "\n"), cut)


def clean_for_embedding(body: Column) -> Column:
    """Reply chain, signature and footer go; runs of three or more line breaks become two; trimmed."""
    out = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n")
    for step in (strip_reply_chain, strip_signature, strip_footer):
        out = _bound(out, step)
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def snippet(chunk: Column, body: Column, size: int = 200) -> Column:
    """The first characters of the chunk, or else of the body, with three dots where more follows."""
    text = F.coalesce(F.nullif(chunk, F.lit("")), body, F.lit(""))
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)
