"""Text expressions: cleaning, slugs, names, HTML, dates, votes, query expansion, URLs, digests, paths.

All are native column expressions; patterns are parameters with the fixed defaults listed first.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the expected results) ----------------------------------------
TRUE_WORDS = ("1", "true", "yes", "y")
QUOTES = "\"'“”‘’"
HANGUL_RUN = r"[가-힣ᄀ-ᇿ㄰-㆏]+"
KANA = r"[぀-ヿㇰ-ㇿ]"
FACE_SUFFIX = "얼굴"
HEAD_CHARS = 4000
DEFAULT_ORIGIN = "https://duckduckgo.com/"
TYPE_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp"}
KNOWN_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")
BLOCKED_SUBSTRINGS = ("herald_logo", "-logo", "_logo", "logo.jpg", "logo.png", "banner", "footer", "header", "icon", "avatar")
DISBANDED_WORDS = (r"\bdisbanded\b", r"\bcontract\s+ended\b", r"\bcontract\s+terminated\b")
UNIT_WORDS = (r"\bsub[-\s]?unit\s+of\b", r"\bunit\s+group\s+of\b")
VIRTUAL_WORDS = (
    r"\bvirtual\s+(girl|boy|K-?pop|idol)?\s*group\b",
    r"\bvirtual\s+idol\s+group\b",
    r"\bVTuber\b",
    r"\bmetaverse\s+(girl|boy|idol)",
)
PROJECT_WORDS = (
    r"\bproject\s+group\b",
    r"\btemporary\s+group\b",
    r"\bone[-\s]?time\s+project\b",
    r"\bformed\s+through\s+.{0,40}\bvariety\s+show\b",
    r"\bspecial\s+(project|collab)\b",
)
FORMER_WORDS = ("former member", "has departed", "left the group", "disbanded", "hiatus")
STOP_MARKERS = ("해체", "계약종료", "사실상해체", "프로젝트종료")
SKIP_NAMES = (r"&", r"\s+[Xx×]\s+", r"/", r"워너비$", r"^음율$|^재쓰비$|^싹쓰리$", r"\d+기$")
DATE_FIELD = r"Debut\s*Date\s*:\s*"
DATE_VERB = r"debuted\s+on\s+"
DATE_FORMS = (r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})", r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})")
STAGE_PAIR = r"(?i)Stage\s*Name\s*:\s*(?:</span>\s*)*[\s\xa0]*([A-Za-z][A-Za-z0-9 _\-.']*?)\s*\(\s*([가-힣][가-힣 \-]*)\s*\)"
STAGE_ONLY = r"(?i)Stage\s*Name\s*:\s*(?:</span>\s*)*[\s\xa0]*([A-Za-z][A-Za-z0-9 _\-.']*?)\s*[(<]"
GROUP_LOCAL = r"(?i)([A-Z][A-Za-z0-9!:'.\s]{1,40})\s*\(\s*([가-힣][가-힣 \-]*)\s*\)\s*is\s+a"
PARAGRAPH = r"(?is)<(?:p|div)\b[^>]*>(.*?)(?=</?(?:p|div)\b|$)"
STAGE_FIELD = r"(?i)Stage\s*(?:/\s*Birth)?\s*Name\s*:\s*(.+?)(?:\n|$|(?=(?:Birth|Korean)\s*Name\s*:))"
LOCAL_FIELD = r"(?i)Korean\s*Name\s*:\s*([가-힣\s]+)"
BIRTH_FIELD = r"(?i)Birth\s*Name\s*:\s*(.+?)(?:\n|$)"
BRACKETS = r"[\(\（]([가-힣\s]+)[\)\）]"
ANY_BRACKETS = r"[\(\（].*?[\)\）]"
LOCAL_RUN = r"([가-힣]{2,})"
CLIP_WORDS = ("fancam", "직캠", "perfcam", "focus")
CLIP_FORCED = "fancam"
QUERY_TEMPLATES = (
    "{hint}",
    "{hint} 고화질",
    "{hint} 직캠",
    "{hint} 셀카",
    "{hint} 포토",
    "{group_en} {member_en} photoshoot",
    "{group_en} {member_en} fancam",
)
NAMED_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
# ---------------------------------------------------------------------------------------------


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def number_or(c: Column, default: float, kind: str = "double") -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))


def term_list(c: Column) -> Column:
    """``|``-separated list -> trimmed non-empty terms."""
    return F.filter(F.transform(F.split(clean(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_label(c: Column) -> Column:
    """Drop straight and curly quotes, collapse whitespace."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{QUOTES}]", ""))


def match_form(c: Column) -> Column:
    return squeeze(F.lower(c))


def name_form(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\-.]", ""))


def alnum_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column, joiner: str = "-") -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", joiner)
    return F.regexp_replace(s, f"^{joiner}+|{joiner}+$", "")


def slug_without_quotes(c: Column) -> Column:
    """Slug where apostrophes and dots vanish instead of splitting the word."""
    return slug(F.regexp_replace(F.lower(F.trim(c)), "['.’]", ""))


def id_slug(c: Column) -> Column:
    s = slug(c, "_")
    return F.when(s == "", "unknown").otherwise(s)


def entity_id(group: Column, name: Column) -> Column:
    return F.concat(id_slug(group), F.lit("__"), id_slug(name))


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    if not table:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), c)


def page_path(name: Column, aliases: dict[str, str] | None = None, paths: dict[str, str] | None = None, suffix: str = "-members-profile") -> Column:
    """Path of a name's page: its slug, or the slug it has in ``aliases``, with ``suffix``; ``paths`` holds those that differ."""
    base = _looked_up(slug(name), aliases or {})
    usual = F.concat(base, F.lit(suffix))
    special = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair]) if paths else None
    return usual if special is None else F.coalesce(F.try_element_at(special, base), usual)


def slug_candidates(name: Column) -> Column:
    """Page slugs to try, in order of preference; empty when nothing is left of the name."""
    low = F.lower(name)
    base = slug(F.regexp_replace(low, "&", "and"))
    packed = F.regexp_replace(low, "[^a-z0-9]", "")
    doubled = F.when(
        low.endswith("s") & (F.length(name) > 4), F.concat(F.regexp_replace(base, "s$", "ss"), F.lit("-members-profile"))
    )
    joined = (packed != "") & (packed != base)
    listed = F.array(
        F.concat(base, F.lit("-members-profile")),
        F.concat(base, F.lit("-profile")),
        F.concat(base, F.lit("-members")),
        base,
        doubled,
        F.when(joined, F.concat(packed, F.lit("-members-profile"))),
        F.when(joined, F.concat(packed, F.lit("-profile"))),
    )
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(listed)))


def decode_numeric_entities(c: Column) -> Column:
    """``&#NNN;`` -> character. Code points outside Unicode stay as text."""
    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(\d{1,7});", 1)
        n = F.when(digits != "", digits.cast("bigint"))
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        ok = n.isNotNull() & (n <= 1114111) & ~n.between(55296, 57343)
        return F.when(ok, F.concat(char, F.substr(p, F.length(digits) + 2))).otherwise(F.concat(F.lit("&#"), p))

    parts = F.split(c, "&#")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), piece)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))


def decode_entities(c: Column) -> Column:
    """``&#NNN;``, ``&#xHHH;`` and the named entities of HTML 4 (and ``&apos;``) -> character, in one pass.

    What names nothing stays as text, and nothing is decoded twice: ``&amp;lt;`` gives ``&lt;``.
    """
    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.lower(F.substring(body, 2, 1)) == "x"
        n = F.when(hexed, F.conv(F.substring(body, 3, 6), 16, 10).cast("bigint")).when(body.startswith("#"), F.substring(body, 2, 7).cast("bigint"))
        ok = n.between(1, 1114111) & ~n.between(55296, 57343)
        char = F.when(body == "", F.lit(None)).when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.try_element_at(named, body))
        return F.when(char.isNotNull(), F.concat(char, F.substr(p, F.length(body) + 2))).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), piece)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))


def strip_html(html: Column) -> Column:
    """Page text: no script or style, tags become spaces, entities decoded, whitespace collapsed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return squeeze(decode_numeric_entities(t))


def tags_to_text(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, r"<[^>]+>", " "))


def page_text(html: Column) -> Column:
    """The tag-free page with single spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")


def head_text(html: Column, n: int = HEAD_CHARS) -> Column:
    """The first ``n`` characters of the tag-free page, where its introduction stands."""
    return F.substring(page_text(html), 1, n)


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    # (?U): word boundaries and spaces in the Unicode sense on every JVM
    return c.rlike("(?iU)(?:" + ")|(?:".join(patterns) + ")")


def page_flags(head: Column) -> dict[str, Column]:
    return {
        "disbanded": any_pattern(head, DISBANDED_WORDS),
        "virtual": any_pattern(head, VIRTUAL_WORDS),
        "project": any_pattern(head, PROJECT_WORDS),
        "unit": any_pattern(head, UNIT_WORDS),
    }


def is_blocked(url: Column, blocked: tuple[str, ...] = BLOCKED_SUBSTRINGS) -> Column:
    low = F.lower(url)
    return F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.contains(low, b))


def pattern_vote(c: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """Label whose patterns hit most; '' unless it strictly leads."""
    scores = F.array_sort(
        F.array(*[
            F.struct((-sum((c.rlike(f"(?iU){p}").cast("int") for p in pats), F.lit(0))).alias("s"), F.lit(label).alias("label"))
            for label, pats in classes.items()
        ])
    )
    first, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    return F.when(first["s"] < second["s"], first["label"]).otherwise(F.lit(""))


def first_of_each(items: Column, field: str) -> Column:
    """The items, in order, whose ``field`` no earlier one has."""
    # lambda variables hold computed values: neither the items nor their fields are computed again per item
    def pick(found: Column) -> Column:
        return bound(F.transform(found, lambda p: p[field]), lambda seen: F.filter(found, lambda p, i: F.array_position(seen, p[field]) == i + 1))

    return bound(items, pick)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field_pairs(html: Column, pair_pattern: str, only_pattern: str, max_len: int | None = None, name_group: int = 1, local_group: int = 2) -> Column:
    """All (name, local) pairs of a page in page order, first occurrence of a name kept.

    Names longer than ``max_len`` are passed over, if it is given. ``only_pattern`` (group 1 = name) is used when ``pair_pattern`` finds nothing. Works inside the row:
    a page's own fields never need a shuffle.
    """
    def build(names: Column, local: Column) -> Column:
        zipped = F.zip_with(F.transform(names, lambda x: F.trim(x)), F.transform(local, lambda x: F.trim(x)), lambda n, k: F.struct(n.alias("name"), k.alias("local")))
        fits = F.filter(zipped, lambda p: (p["name"] != "") & (F.lit(True) if max_len is None else F.length(p["name"]) <= max_len))
        return first_of_each(fits, "name")

    both = build(
        F.regexp_extract_all(html, F.lit(pair_pattern), F.lit(name_group)), F.regexp_extract_all(html, F.lit(pair_pattern), F.lit(local_group))
    )
    names = F.regexp_extract_all(html, F.lit(only_pattern), F.lit(1))
    only = build(names, F.transform(names, lambda x: F.lit("")))
    return F.when(F.size(both) > 0, both).otherwise(only)



def before_stop(c: Column, stop: str) -> Column:
    """Text before the first match of ``stop`` (all of it when there is none)."""
    at = F.regexp_instr(c, F.lit(stop))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def group_local(page: Column, pattern: str = GROUP_LOCAL) -> Column:
    """Local name of the group in the sentence that introduces it, "" where there is none."""
    return F.trim(F.coalesce(F.regexp_extract(page, pattern, 2), F.lit("")))


def current_fields(html: Column, former: tuple[str, ...] = FORMER_WORDS) -> Column:
    """(name, local) of the people a page lists before its section on former ones, in page order.

    A paragraph with a stage name begins a person. The section begins at the first paragraph that has one
    of ``former`` and no stage name. The local name is that in brackets behind the stage name, else that of
    the person's first paragraph with a local-name field, or with a birth name in brackets or in the local script.
    """
    paragraphs = F.filter(F.transform(F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1)), lambda p: strip_html(p)), lambda p: p != "")

    def ends(p: Column) -> Column:
        low = F.lower(p)
        words = F.lit(False)
        for word in former:
            words = words | F.contains(low, F.lit(word))
        return words & ~F.contains(low, F.lit("stage name"))

    def until(ps: Column) -> Column:
        stop = F.array_position(F.transform(ps, ends), F.lit(True))
        return F.when(stop > 0, F.slice(ps, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(ps)

    def some(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    def local_of(p: Column) -> Column:
        birth = F.regexp_extract(p, BIRTH_FIELD, 1)
        return F.coalesce(some(F.regexp_extract(p, LOCAL_FIELD, 1)), some(F.regexp_extract(birth, BRACKETS, 1)), some(F.regexp_extract(birth, LOCAL_RUN, 1)))

    def people(ps: Column) -> Column:
        at = F.filter(F.transform(ps, lambda p, i: F.when(p.rlike(STAGE_FIELD), i)), lambda i: i.isNotNull())

        def person(begin: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(ps))
            line = F.regexp_extract(F.get(ps, begin), STAGE_FIELD, 1)
            later = F.filter(F.transform(F.slice(ps, begin + 1, end - begin), local_of), lambda x: x.isNotNull())
            name = F.trim(F.regexp_replace(line, ANY_BRACKETS, ""))
            return F.struct(name.alias("name"), F.coalesce(some(F.regexp_extract(line, BRACKETS, 1)), F.get(later, F.lit(0)), F.lit("")).alias("local"))

        return F.filter(F.transform(at, person), lambda x: x["name"] != "")

    return bound(bound(paragraphs, until), people)


def script_segment(raw: Column, run: str = HANGUL_RUN, drop: str = KANA) -> Column:
    """Of ``a / b`` keep the part with most runs of one script (first wins), then drop another script."""
    parts = F.transform(F.split(raw, "/"), lambda x: F.trim(x))
    scored = F.transform(parts, lambda p, i: F.struct(F.size(F.regexp_extract_all(p, F.lit(run), F.lit(0))).alias("n"), (-i).alias("i"), p.alias("p")))
    picked = F.when(F.contains(raw, F.lit("/")), F.array_max(scored)["p"]).otherwise(raw)
    return F.trim(F.regexp_replace(picked, drop, ""))


def parse_day(s: Column) -> Column:
    """``2024.1.31``, ``2024/01/31``, ``January 31, 2024`` or ``31 Jan 2024`` -> date, else null."""
    s = F.trim(s)
    ymd, mdy, dmy = DATE_FORMS
    months = "january february march april may june july august september october november december".split()
    short = {m[:3]: i + 1 for i, m in enumerate(months)} | {"sept": 9} | {m: i + 1 for i, m in enumerate(months)}
    table = F.create_map(*[x for k, v in short.items() for x in (F.lit(k), F.lit(v))])

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def part(p: str, i: int) -> Column:
        return F.regexp_extract(s, p, i)

    def month(p: str, i: int) -> Column:
        return F.try_element_at(table, F.lower(part(p, i)))

    return F.coalesce(
        F.when(s.rlike(ymd), day(part(ymd, 1), part(ymd, 2), part(ymd, 3))),
        F.when(s.rlike(mdy), day(part(mdy, 3), month(mdy, 1), part(mdy, 2))),
        F.when(s.rlike(dmy), day(part(dmy, 3), month(dmy, 2), part(dmy, 1))),
    )


def date_field(page: Column, label: str = DATE_FIELD, verb: str = DATE_VERB) -> Column:
    """First of four field forms on the page that is found and parses."""
    forms = (
        label + r"([A-Za-z]+\s+\d{1,2},\s*\d{4})",
        label + r"(\d{4}[./]\d{1,2}[./]\d{1,2})",
        label + r"(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
        verb + r"([A-Za-z]+\s+\d{1,2},\s*\d{4})",
    )
    return F.coalesce(*[parse_day(F.regexp_extract(page, f"(?i){p}", 1)) for p in forms])


def quoted(term: Column) -> Column:
    return F.when(F.contains(term, F.lit(" ")), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def search_queries(hint: Column, group: Column, name: Column, include: Column, exclude: Column, templates: tuple[str, ...] = QUERY_TEMPLATES) -> Column:
    """Distinct search queries in template order: missing include terms added, exclude terms negated."""
    def fill(template: str) -> Column:
        base = F.lit(template)
        for mark, value in (("{hint}", hint), ("{group_en}", group), ("{member_en}", name)):
            base = F.replace(base, F.lit(mark), F.trim(value))
        base = F.trim(base)
        low = F.lower(base)
        missing = F.transform(F.filter(include, lambda t: ~F.contains(low, F.lower(t))), quoted)
        negated = F.transform(exclude, lambda t: F.concat(F.lit("-"), quoted(t)))
        parts = F.filter(F.concat(F.array(base), missing, negated), lambda p: p != "")
        return F.when(base != "", F.trim(F.array_join(parts, " ")))

    return F.filter(F.array_distinct(F.array_compact(F.array(*[fill(t) for t in templates]))), lambda q: q != "")


def keyword_queries(queries: Column, hint: Column, keywords: tuple[str, ...] = CLIP_WORDS, forced: str = CLIP_FORCED) -> Column:
    """The queries that hold one of ``keywords``; without any, the hint with the ``forced`` word."""
    def fits(q: Column) -> Column:
        low = F.lower(q)
        found = F.lit(False)
        for word in keywords:
            found = found | F.contains(low, F.lit(word))
        return found

    kept = F.filter(queries, fits)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.concat(hint, F.lit(" " + forced))))


def replace_first(c: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence; unchanged when either side is empty."""
    at = F.instr(c, old)
    return F.when((old != "") & (new != "") & (at > 0), F.overlay(c, new, at, F.length(old))).otherwise(c)


def last_token(hint: Column, suffix: str = FACE_SUFFIX) -> Column:
    t = F.trim(hint)
    t = F.when(t.endswith(suffix), F.trim(F.substring(t, F.lit(1), F.length(t) - len(suffix)))).otherwise(t)
    return F.coalesce(F.try_element_at(F.split(t, r"\s+"), F.lit(-1)), F.lit(""))


def url_origin(url: Column, source_page: Column, default: str = DEFAULT_ORIGIN) -> Column:
    target = F.when(clean(source_page) != "", F.trim(source_page)).otherwise(url)
    scheme = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)", 1)
    host = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)", 2)
    return F.when((scheme != "") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), host, F.lit("/"))).otherwise(default)


def file_extension(url: Column, content_type: Column) -> Column:
    """Extension from the content type, else the URL path suffix, else ``.jpg``."""
    kind = F.lower(F.trim(F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), F.lit(0))))
    table = F.create_map(*[F.lit(x) for kv in TYPE_EXTENSIONS.items() for x in kv])
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    known = F.when(suffix.isin(*KNOWN_SUFFIXES), F.when(suffix == ".jpeg", ".jpg").otherwise(suffix))
    return F.coalesce(F.try_element_at(table, kind), known, F.lit(".jpg"))


def quote_url(url: Column) -> Column:
    """Percent-quote path and query of a URL byte-wise, keeping the characters URLs use themselves."""
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

    def quote(part: Column, safe: str) -> Column:
        encoded = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
        encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        for ch in safe:
            encoded = F.replace(encoded, F.lit("%" + format(ord(ch), "02X")), F.lit(ch))
        return encoded

    query, fragment = F.regexp_extract(url, shape, 3), F.regexp_extract(url, shape, 4)
    return F.concat(
        F.regexp_extract(url, shape, 1),
        quote(F.regexp_extract(url, shape, 2), "/%:@"),
        F.when(query != "", F.concat(F.lit("?"), quote(query, "=&?/%:@,+"))).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), quote(fragment, ""))).otherwise(""),
    )


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def digest_prefix(c: Column) -> Column:
    return F.substring(digest(c), 1, 12)


def stem_digest(path: Column) -> Column:
    """Text after the first ``_`` of the file stem."""
    return F.regexp_extract(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""), r"^[^_]*_(.+)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def normal_path(path: Column, root: str) -> Column:
    """Forward slashes, absolute (relative paths hang below ``root``)."""
    p = F.replace(clean(path), F.lit("\\"), F.lit("/"))
    return F.when(p == "", "").when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def crop_path(path: Column, crop_root: str) -> Column:
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit(crop_root.rstrip("/") + "/"), F.element_at(F.split(path, "/"), -2), F.lit("/"), stem, F.lit("_face.jpg"))


def section_between(c: Column, start: str, stop: str | None) -> Column:
    """Text after the first ``start`` label up to the next ``stop`` label (or the end); null when absent."""
    at = F.instr(c, start)
    body = F.when(at > 0, F.substring(c, at + len(start), F.length(c)))
    if not stop:
        return body
    end = F.instr(body, stop)
    return F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body)


def year_list(section: Column, year: str = r"20\d\d", stop_markers: tuple[str, ...] = STOP_MARKERS, skip: tuple[str, ...] = SKIP_NAMES) -> Column:
    """``YYYY a , b [marker] , c YYYY ...`` -> array of (year, name), stopped and skipped items dropped."""
    blocks = F.transform(F.split(section, rf"\s(?=(?:{year})\s)"), lambda x: F.trim(x))
    dated = F.filter(blocks, lambda b: b.rlike(rf"^{year}\s+.+$"))

    def items(block: Column) -> Column:
        y = F.regexp_extract(block, rf"^({year})\s+(.+)$", 1).cast("int")
        names = F.split(F.regexp_extract(block, rf"^({year})\s+(.+)$", 2), ",")
        return F.transform(names, lambda n: F.struct(y.alias("year"), F.trim(n).alias("raw"), F.trim(F.regexp_replace(n, r"\[[^\]]*\]", "")).alias("name")))

    def keep(p: Column) -> Column:
        marks = F.array_join(F.regexp_extract_all(p["raw"], F.lit(r"\[([^\]]+)\]"), F.lit(1)), "\n")
        stopped = F.exists(F.array(*[F.lit(m) for m in stop_markers]), lambda m: F.contains(marks, m))
        skipped = p["name"].rlike("(?:" + ")|(?:".join(skip) + ")")
        return (F.length(p["name"]) >= 2) & ~stopped & ~skipped

    return F.filter(F.flatten(F.transform(dated, items)), keep)
