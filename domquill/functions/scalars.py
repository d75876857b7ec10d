"""Scalar functions as Column builders: text, addresses, times, numbers, lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the source language's patterns see it, where Java's \s lacks some.
SPACE = r"[\s\x{FEFF}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(s: Column) -> Column:
    """Null is an empty string."""
    return F.coalesce(F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def tag_trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def camel_case(s: Column) -> Column:
    """-x to X; a leading -ms- to ms-."""
    words = F.split(F.regexp_replace(s, "^-ms-", "ms-"), "-(?=[0-9A-Za-z])")
    return F.array_join(F.transform(words, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1)))), "")


def decamelize(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, "([A-Z])", "-$1"))


def linkify(s: Column) -> Column:
    """Addresses, then @names, then #tags to anchors, each over what the one before made. An address
    is shown without its scheme."""
    # The three patterns and addresses, which decide the output.
    s = F.regexp_replace(s, r"(?i)(https?://)([\w\-:;?&=+.%#/]+)", r'<a href="$1$2">$2</a>')
    s = F.regexp_replace(s, r"(^|\W)@(\w+)", r'$1<a href="https://twitter.com/$2">@$2</a>')
    return F.regexp_replace(s, r"(^|\W)#(\w+)", r'$1<a href="https://search.twitter.com/search?q=%23$2">#$2</a>')


def expand_urls(s: Column, urls: Column) -> Column:
    """Each entry's short address replaced by its long one, then where it is shown, which is without
    its scheme, by the text to show; in order. Entries without a long address are left out, and
    without a text to show only the address changes."""

    def one(acc: Column, u: Column) -> Column:
        long = F.replace(acc, u["url"], u["expanded_url"])
        bare = F.regexp_replace(u["url"], "https?://", "")
        shown = F.coalesce(F.replace(long, F.concat(F.lit(">"), bare), F.concat(F.lit(">"), u["display_url"])), long)
        return F.coalesce(shown, acc)

    return F.aggregate(urls, s, one)


def newline_to_br(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("<br>"))


def html_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_unescape(s: Column) -> Column:
    """What ``html_escape`` was given. No other references are known, nor any without its semicolon."""
    return F.replace(F.replace(F.replace(s, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def cook_quirk(s: Column) -> Column:
    """The weak escape as it was shipped: the first < and the first > only, the latter misspelt."""
    return F.regexp_replace(F.regexp_replace(s, "(?s)^([^<]*)<", r"$1&lt;"), "(?s)^([^>]*)>", r"$1&gt>")


def width_escape(s: Column) -> Column:
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit("&amp;")), SPACE, " ")
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def not_blank(s: Column) -> Column:
    return F.when(F.length(trim(s)) > 0, s)


def placeholder_value(value: Column, placeholder: Column, flagged: Column) -> Column:
    return F.when(flagged & (value == placeholder), "").otherwise(value)


def placeholder_set(value: Column, placeholder: Column) -> Column:
    """(value, flagged) of a field that is given a value: without one it shows its placeholder."""
    blank = F.coalesce(value, F.lit("")) == ""
    return F.struct(F.when(blank, placeholder).otherwise(value).alias("value"), blank.alias("flagged"))


def strip_tag_suffix(s: Column) -> Column:
    return F.regexp_replace(s, "_tag$", "")


def strip_close_mark(s: Column) -> Column:
    return F.regexp_replace(s, f"{SPACE}+x$", "")


def anchor_fragment(s: Column) -> Column:
    return F.regexp_replace(s, r".*(?=#[^\s]+$)", "")


def node_name_is(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def strip_returns(s: Column) -> Column:
    return F.replace(s, F.lit("\r"), F.lit(""))


def to_crlf(s: Column) -> Column:
    return F.regexp_replace(s, "\r?\n", "\r\n")


def fill_template(s: Column, values: dict[str, Column]) -> Column:
    """{{ name }} by its value, the first place of each name only."""
    for name, value in values.items():
        mark = f"{{{{ {name} }}}}"
        at = F.instr(s, mark)
        s = F.when(at > 0, F.concat(F.substring_index(s, mark, 1), value, F.substr(s, at + len(mark)))).otherwise(s)
    return s


# Addresses


def query_param(search: Column, name: str | None = None, hash_: Column | None = None) -> Column:
    """The first value of a name in the query, as written; "" if there is none; without a name
    the whole query. An empty search falls back to the hash. What has no "=" has the empty name."""
    s = F.coalesce(F.nullif(search, F.lit("")), hash_ if hash_ is not None else F.lit(""), F.lit(""))
    s = F.when(F.contains(s, F.lit("?")), F.get(F.split(s, r"\?"), F.lit(1))).otherwise(s)
    if name is None:
        return url_encode_if_needed(s)
    own = lambda p: F.when(F.contains(p, F.lit("=")), F.substring_index(p, "=", 1)).otherwise("")
    hit = F.get(F.filter(F.split(s, "&"), lambda p: own(p) == name), F.lit(0))
    value = F.substr(hit, F.position(F.lit("="), hit) + 1)
    return url_encode_if_needed(F.coalesce(value, F.lit("")))


def encode_component(s: Column) -> Column:
    """Percent encoding that leaves letters, digits and - _ . ! ~ * ' ( ) as they are."""
    s = F.url_encode(s)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        s = F.replace(s, F.lit(coded), F.lit(plain))
    return s


def url_encode_if_needed(s: Column) -> Column:
    return F.when(s.rlike(r'[\\"<>.;]'), encode_component(s)).otherwise(s)


def param(pairs: Column) -> Column:
    """array<struct<k, v>> as a query string: null values empty, blanks as plus signs."""
    enc = lambda x: F.replace(encode_component(x), F.lit("%20"), F.lit("+"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(enc(p["k"]), F.lit("="), enc(F.coalesce(p["v"], F.lit(""))))), "&")


def param_lists(m: Column, traditional: bool = False) -> Column:
    """map<string, array<string>> as a query string: a pair for each value, names with [] unless
    traditional, or where they have it."""
    named = lambda k: k if traditional else F.when(k.endswith("[]"), k).otherwise(F.concat(k, F.lit("[]")))
    return param(F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda v: F.struct(named(e["key"]).alias("k"), v.alias("v"))))))


def param_nested(m: Column) -> Column:
    """map<string, map<string, string>> as a query string of name[inner]=value."""
    pair = lambda e, x: F.struct(F.concat(e["key"], F.lit("["), x["key"], F.lit("]")).alias("k"), x["value"].alias("v"))
    return param(F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(F.map_entries(e["value"]), lambda x: pair(e, x)))))


def query_pairs(s: Column) -> Column:
    """A query string to array<struct<k, v>>, repeats kept."""
    return F.transform(F.filter(F.split(F.regexp_replace(s, r"^\?", ""), "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.substr(p, F.position(F.lit("="), p) + 1)).otherwise("").alias("v")))


def flash_vars(m: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host and port are equal; ports left out are the scheme's own."""

    def origin(u: Column) -> Column:
        part = lambda k: F.lower(F.regexp_extract(u, r"^([\w.+-]+:)(?://([^/?#:]*)(?::(\d+))?)", k))
        port = F.coalesce(F.nullif(part(3), F.lit("")), F.when(part(1) == "http:", "80").when(part(1) == "https:", "443").otherwise(""))
        return F.concat_ws("|", part(1), part(2), port)

    return origin(a) == origin(b)


def strip_hash(u: Column, scheme: str = "http:") -> Column:
    return F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^//", f"{scheme}//")


# Times


def parse_date(s: Column) -> Column:
    """ISO 8601, or "Mon Sep 24 03:35:21 +0000 2012"; null if neither."""
    bare = F.regexp_replace(s, r"^[A-Z][a-z]{2},? ", "")
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(bare, F.lit("MMM dd HH:mm:ss Z yyyy")))


def pretty_date(t: Column, now: Column) -> Column:
    """How long ago, shortly. A minute is added to the age; what is null or lies further ahead
    gets the infinity mark."""
    diff = F.floor((F.unix_millis(now.cast("timestamp")) + 60_000 - F.unix_millis(t.cast("timestamp"))) / 1000)
    day = F.floor(diff / 86400)
    unit = lambda n, u: F.concat(n.cast("long").cast("string"), F.lit(u))
    return (
        F.when(diff.isNull() | (day < 0), "<span>&infin;</span>")
        .when(day == 0, F.when(diff < 60, " now").when(diff < 120, "1m").when(diff < 3600, unit(F.floor(diff / 60), "m")).when(diff < 7200, "1h").otherwise(unit(F.floor(diff / 3600), "h")))
        .when(day == 1, "1d")
        .when(day < 7, unit(day, "d"))
        .when(day == 7, "1w")
        .otherwise(unit(F.ceil(day / 7), "w"))
    )


# Numbers


def is_numeric(s: Column) -> Column:
    return F.coalesce(s.cast("string").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*0[xX][0-9a-fA-F]+\s*$"), F.lit(False))


def parse_int(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def version_parts(s: Column) -> Column:
    part = lambda i: F.coalesce(parse_int(F.coalesce(F.get(F.split(s, r"\."), F.lit(i)), F.lit("0"))), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("release"))


def version_ge(have: Column, want: Column) -> Column:
    return version_parts(have) >= version_parts(want)


def extract_version(description: Column) -> Column:
    """"Shockwave Flash 11.2 r202" to "11.2.202"."""
    p = lambda r: F.coalesce(F.nullif(F.regexp_extract(description, r, 1), F.lit("")), F.lit("0"))
    return F.concat_ws(".", p(r"(\d+)\."), p(r"\d+\.(\d+)"), p(r"[a-zA-Z]+(\d+)\s*$"))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def swing(p: Column) -> Column:
    return 0.5 - F.cos(p * F.pi()) / 2


# Lists


def in_array(a: Column, x: Column | str, start: int = 0) -> Column:
    """Place from 0, or -1; a null list has none of anything."""
    if not start:
        return F.coalesce(F.array_position(a, x) - 1, F.lit(-1).cast("long"))
    rest = F.array_position(F.slice(a, start + 1, F.greatest(F.size(a), F.lit(1))), x)
    return F.coalesce(F.when(rest > 0, rest - 1 + start), F.lit(-1).cast("long"))


def make_array(x: Column) -> Column:
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))


def map_flat(a: Column, f) -> Column:
    """Results that are null go, lists among them come in one level flatter: ``f`` gives lists."""
    return F.filter(F.flatten(F.filter(F.transform(a, f), lambda x: x.isNotNull())), lambda x: x.isNotNull())


def map_values(a: Column, f) -> Column:
    """Results that aren't null."""
    return F.filter(F.transform(a, f), lambda x: x.isNotNull())


def unique(a: Column) -> Column:
    """Each element once, where it is first."""
    return F.array_distinct(a)


def raw_sort(a: Column) -> Column:
    """Sorted by the elements' texts, as an order that isn't given is."""
    pairs = F.array_sort(F.transform(a, lambda x: F.struct(x.cast("string").alias("s"), x.alias("x"))))
    return F.transform(pairs, lambda p: p["x"])


def each_until(a: Column, go_on) -> Column:
    """The elements up to the first for which ``go_on`` is false, that one included."""
    stop = F.array_position(F.transform(a, lambda x: F.coalesce(go_on(x), F.lit(True))), False)
    return F.when(stop > 0, F.slice(a, 1, stop.cast("int"))).otherwise(a)


def grep(a: Column, keep, invert: bool = False) -> Column:
    return F.filter(a, lambda x: ~F.coalesce(keep(x), F.lit(False)) if invert else F.coalesce(keep(x), F.lit(False)))


def _literal(delimiter: str) -> str:
    return f"\\Q{delimiter}\\E"


def tags(s: Column, delimiter: str = ",") -> Column:
    """A tag string's tags: trimmed, empty ones left out, repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), _literal(delimiter)), tag_trim), lambda t: t != "")


def tag_exists(s: Column, tag: str, delimiter: str = ",") -> Column:
    return F.array_contains(F.split(F.coalesce(s, F.lit("")), _literal(delimiter)), tag)


def add_tag(s: Column, tag: Column | str, delimiter: str = ",", unique: bool = True) -> Column:
    tag = tag_trim(F.lit(tag) if isinstance(tag, str) else tag)
    have = F.filter(F.split(F.coalesce(s, F.lit("")), _literal(delimiter)), lambda t: t != "")
    skip = (tag == "") | (F.array_contains(have, tag) if unique else F.lit(False))
    return F.array_join(F.when(skip, have).otherwise(F.array_append(have, tag)), delimiter)


def remove_tag(s: Column, tag: str, delimiter: str = ",") -> Column:
    """Less all that are the tag as written; the others are imported again, trimmed."""
    left = F.filter(F.split(F.coalesce(s, F.lit("")), _literal(delimiter)), lambda t: t != tag)
    return F.array_join(F.filter(F.transform(left, tag_trim), lambda t: t != ""), delimiter)


def import_tags(s: Column, delimiter: str = ",") -> Column:
    return F.array_join(tags(s, delimiter), delimiter)


def length_in_bounds(s: Column, least: int, most: int | None = None) -> Column:
    n = F.length(s)
    return (n >= least) & (F.lit(True) if not most else n <= most)


def add_class(classes: Column, more: Column) -> Column:
    return F.array_union(classes, more)


def remove_class(classes: Column, gone: Column) -> Column:
    return F.array_except(classes, gone)


def toggle_class(classes: Column, own: Column) -> Column:
    return F.array_union(F.array_except(classes, own), F.array_except(own, classes))


# Maps


def extend(a: Column, b: Column) -> Column:
    """Two maps; the later one's values win where they aren't null."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def extend_deep(a: Column, b: Column) -> Column:
    """Two maps of maps: inner maps are merged, the later one's values win where they aren't null."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(extend(x, y)))


def extend_lists(a: Column, b: Column) -> Column:
    """Two lists merged place by place, the later one's values win where they aren't null."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(y, x))


def copy_attributes(attrs: Column) -> Column:
    """All attributes but those a library marks its elements with."""
    return F.map_filter(attrs, lambda k, v: ~k.rlike(r"^jQuery\d+$"))


def is_empty(m: Column) -> Column:
    return F.coalesce(F.size(m) <= 0, F.lit(True))


def type_of(v: Column) -> Column:
    """A VARIANT's type by its usual name: null, boolean, number, string, array or object."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), "null").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise(F.lower(t))
    )


def is_plain_object(v: Column) -> Column:
    return type_of(v) == "object"


def coerce_data(s: Column) -> Column:
    """A data attribute's text as VARIANT: true, false, null, numbers that read back alike, JSON
    objects and lists; anything else stays text, bad JSON too."""
    number = s.rlike(r"^(0|-?[1-9]\d{0,14}|-?(0|[1-9]\d{0,14})\.\d{0,14}[1-9])$")
    json = s.isin("true", "false", "null") | number | s.rlike(r"(?s)^(?:\{.*\}|\[.*\])$")
    text = F.to_variant_object(F.struct(s.alias("v")))
    return F.coalesce(F.when(json, F.try_parse_json(s)), F.variant_get(text, "$.v", "variant"))


def data_attributes(attrs: Column) -> Column:
    """The data-* attributes, names without the prefix in camel case."""
    own = F.map_filter(attrs, lambda k, v: k.startswith("data-"))
    return F.transform_keys(own, lambda k, v: camel_case(F.substr(k, F.lit(6))))


def options(defaults: Column, attributes: Column, arguments: Column) -> Column:
    return extend(extend(defaults, attributes), arguments)


def icon(classes: Column, table: dict[str, str], prefix: str) -> Column:
    """What a table has for the first class with the prefix; null without one, or on a miss."""
    name = F.nullif(F.regexp_extract(classes, prefix + r"[^\s'\"]+", 0), F.lit(""))
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), name)
