"""Text functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of ECMAScript's \s, as a Java character class.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The same characters, one by one.
WS_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _rewrite(text: Column, rules: list[tuple]) -> Column:
    """Rules (pattern, replacement, strings) in order; one with strings is only tried on texts that have one of these, which any match holds."""

    def one(t: Column, pattern: str, said: str, *strings: str) -> Column:
        if not strings:
            return F.regexp_replace(t, pattern, said)
        some = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(s)) for s in strings])
        return F.element_at(F.transform(F.array(t), lambda x: F.when(some(x), F.regexp_replace(x, pattern, said)).otherwise(x)), 1)

    return reduce(lambda t, rule: one(t, *rule), rules, text)


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARACTERS))


def normalize_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, f"{WS}+", " "))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; without a character of four bytes that is the number of characters."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text).cast("long")).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"))


def markdown_to_text(markdown: Column) -> Column:
    """Plain text of Markdown: no images, links by their text, no rules, heading marks, emphasis or table bars."""
    return trim_ws(_rewrite(markdown, [
        (r"!\[[^\]]*\]\([^)]*\)", " ", "!["), (r"\[([^\]]*)\]\([^)]*\)", "$1", "]("),
        (rf"(?<=\A|[\n\r\x{{2028}}\x{{2029}}]){WS}*\|?{WS}*:?-{{3,}}[^\n\r\x{{2028}}\x{{2029}}]*(?=[\n\r\x{{2028}}\x{{2029}}]|\z)", "", "---"),
        (rf"(?<=\A|[\n\r\x{{2028}}\x{{2029}}])#{{1,6}}{WS}+", "", "#"), (r"[*_`>]+", "", "*", "_", "`", ">"), (rf"{WS}*+\|{WS}*+", " ", "|"), (r"[ \t]+", " ", "  ", "\t"), (r"\n{3,}", "\n\n", "\n\n\n"),
    ]))


def html_to_text(html: Column) -> Column:
    """Text of HTML or XML: script, style and comments go, blocks end in blank lines, five entities are decoded."""
    stripped = _rewrite(html, [
        (r"(?is)<(script|style).*?</\1>", " "), (r"(?s)<!--.*?-->", " ", "<!--"), (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|li|tr|h[0-9]|section|article|table|ul|ol)>", "\n\n"), (r"<[^>]+>", " "),
    ])
    decoded = stripped
    for entity, said in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(said))
    return trim_ws(_rewrite(decoded, [(r"[ \t]+", " ", "  ", "\t"), (r" *\n *", "\n", " \n", "\n "), (r"\n{3,}", "\n\n", "\n\n\n")]))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]+', "__")


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSS+hh'mm' as ISO; missing parts are 01, 00 and Z; anything else stays."""
    pattern = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+-])(\d{2})'?(\d{2})?'?|Z)?"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(value, pattern, i), F.lit("")), F.lit(default))
    zone = F.when(part(7, "") == "", "Z").otherwise(F.concat(part(7, ""), part(8, "00"), F.lit(":"), part(9, "00")))
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
    return F.when(F.rlike(value, F.lit(pattern)), iso).otherwise(value)


def column_index(letters: Column) -> Column:
    """Spreadsheet letters to a 0-based number."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1


def decode_bytes(content: Column) -> Column:
    """Text of bytes by their byte order mark; without one UTF-8, what is broken replaced."""
    hexed = F.hex(F.substring(content, 1, 3))
    return (
        F.when(hexed == "EFBBBF", F.make_valid_utf8(F.substring(content, 4, 2_000_000_000).cast("string")))
        .when(F.substring(hexed, 1, 4) == "FFFE", F.decode(F.substring(content, 3, 2_000_000_000), "UTF-16LE"))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def md_table(rows: Column) -> Column:
    """A Markdown table of an array of rows (arrays of strings); rows are padded to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    clean = lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.replace(F.replace(F.coalesce(F.get(r, i), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    lines = F.transform(rows, lambda r: line(clean(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.coalesce(width, F.lit(0)) <= 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n"))


def decode_xml(text: Column) -> Column:
    """Character references of XML: by number, then the five names, ``&amp;`` last."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&?[^&]*"), F.lit(0))

    def one(p: Column) -> Column:
        number = F.when(F.rlike(p, F.lit(r"^&#[xX]")), F.conv(F.regexp_extract(p, r"([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(p, r"([0-9]+);", 1)).cast("long")
        return F.when(F.rlike(p, F.lit(r"^&#(?:[xX][0-9A-Fa-f]+|[0-9]+);$")) & (number < 0x110000), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(p)

    told = F.array_join(F.transform(pieces, one), "")
    for name, said in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        told = F.replace(told, F.lit(f"&{name};"), F.lit(said))
    return told


def pick_defined(values: Column) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def shown(value: Column) -> Column:
    """A value in a report; n/a for none."""
    return F.coalesce(value.cast("string"), F.lit("n/a"))


def table_text(table: Column) -> Column:
    """The plain text of a Markdown table."""
    return markdown_to_text(table)


def safe_average(value: Column) -> Column:
    """The average of what is a number, to three places; null without any."""
    number = value.cast("double")
    return round3(F.avg(F.when(~F.isnan(number), number)))


def round3(value: Column) -> Column:
    """Rounded half up to three places."""
    return F.floor(value * 1000 + 0.5) / 1000
