"""Archived job feeds: links, snapshot ids and advert keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtide.constants import ARCHIVE_ROOT, JOB_FEED_URL
from tagtide.functions.binding import bind

_NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_ANCHOR = r"(?i)<a\s[^>]*>"
_HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def link_targets(html: Column) -> Column:
    """``href`` of every anchor in page order; comments, scripts and styles hold no anchors."""
    anchors = F.regexp_extract_all(F.regexp_replace(html, _NOT_MARKUP, ""), F.lit(_ANCHOR), F.lit(0))
    targets = F.transform(
        anchors,
        # Only one of the three quoting styles matches; the others give ''.
        lambda a: F.when(
            F.regexp_like(a, F.lit(_HREF)),
            F.concat(*[F.regexp_extract(a, _HREF, group) for group in (1, 2, 3)]),
        ),
    )
    return F.transform(F.array_compact(targets), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def snapshot_links(html: Column, path_part: str = "/web/", root: str = ARCHIVE_ROOT) -> Column:
    """Targets whose path holds ``path_part``, below ``root``."""
    wanted = F.filter(link_targets(html), lambda t: F.contains(t, F.lit(path_part)))
    return F.transform(wanted, lambda t: F.concat(F.lit(root), t))


def snapshot_id(url: Column, path_part: str = "/web/", until: str = "/http") -> Column:
    """Text between the first ``path_part`` and the next ``until``; null without ``path_part``."""
    after = F.split_part(url, F.lit(path_part), F.lit(2))
    return F.when(F.contains(url, F.lit(path_part)), F.split_part(after, F.lit(until), F.lit(1)))


def snapshot_url(id_or_url: Column, root: str = ARCHIVE_ROOT, feed_url: str = JOB_FEED_URL) -> Column:
    """A bare id becomes the archive address of the feed; an address stays."""
    address = F.concat(F.lit(root + "web/"), id_or_url, F.lit("/" + feed_url))
    return F.when(id_or_url.try_cast("bigint").isNotNull(), address).otherwise(id_or_url)


# Fixed values of HTML: names of character entities, which XML does not know.
# Latin-1, code points 160 to 255 in order:
LATIN1_ENTITIES = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr "
    "deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest "
    "Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml "
    "ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig "
    "agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml "
    "eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml"
).split()
# Punctuation and symbols that feeds use most, with their code points:
OTHER_ENTITIES = {
    "OElig": 338, "oelig": 339, "Scaron": 352, "scaron": 353, "Yuml": 376, "fnof": 402, "circ": 710, "tilde": 732,
    "ensp": 8194, "emsp": 8195, "thinsp": 8201, "zwnj": 8204, "zwj": 8205, "lrm": 8206, "rlm": 8207,
    "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "sbquo": 8218, "ldquo": 8220, "rdquo": 8221,
    "bdquo": 8222, "dagger": 8224, "Dagger": 8225, "bull": 8226, "hellip": 8230, "permil": 8240, "prime": 8242,
    "Prime": 8243, "lsaquo": 8249, "rsaquo": 8250, "oline": 8254, "frasl": 8260, "euro": 8364, "trade": 8482,
    "larr": 8592, "uarr": 8593, "rarr": 8594, "darr": 8595, "harr": 8596,
}
assert len(LATIN1_ENTITIES) == 96
XML_ENTITIES = ("amp", "lt", "gt", "quot", "apos")

# Markup tokens, leftmost first: a comment, a CDATA section (either to its end or to the end of the
# text), a tag that opens or closes an item, a run of text and other tags, any other tag, a stray '<'.
# The run is possessive, so a long one needs no stack.
_TOKEN = (
    r"(?s)<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<item(?:\s[^<>]*)?>|</item\s*>"
    r"|(?:[^<]++|<(?!!--|!\[CDATA\[|/?item[\s>])[^<>]*+>)++|<[^<>]*>|<"
)
_PIECE = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);|[^&]+|&"
_OPEN = r"^<item(?:\s[^<>]*)?>$"
_CLOSE = r"^</item\s*>$"


def _entities() -> Column:
    numbered = {name: 160 + i for i, name in enumerate(LATIN1_ENTITIES)} | OTHER_ENTITIES
    return F.create_map(*[F.lit(x) for name, code in numbered.items() for x in (f"&{name};", f"&#{code};")])


def repair(text: Column) -> Column:
    """Text that XML can read: HTML entities as character references, bare ampersands escaped.

    References of XML stay; a named entity that neither XML nor :data:`LATIN1_ENTITIES` or
    :data:`OTHER_ENTITIES` knows stays as its literal text.
    """
    known = _entities()
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))

    def one(p: Column) -> Column:
        entity = F.startswith(p, F.lit("&")) & F.endswith(p, F.lit(";"))
        xml = p.isin(*[f"&{e};" for e in XML_ENTITIES]) | F.startswith(p, F.lit("&#"))
        return (
            F.when(p == "&", F.lit("&amp;"))
            .when(entity & xml, p)
            .when(entity, F.coalesce(F.element_at(known, p), F.concat(F.lit("&amp;"), F.substring(p, 2, 1 << 30))))
            .otherwise(p)
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def feed_tokens(rss: Column) -> Column:
    """The feed as markup tokens, ready for XML: comments empty, CDATA as it is, tags and text repaired.

    What stands between two tags of items is one token, unless a comment, CDATA or a stray ``<`` cuts it.
    """
    tokens = F.regexp_extract_all(rss, F.lit(_TOKEN), F.lit(0))
    return F.transform(
        tokens,
        lambda t: F.when(F.startswith(t, F.lit("<!--")), F.lit(""))
        .when(F.startswith(t, F.lit("<![CDATA[")), t)
        .when(t == "<", F.lit("&lt;"))
        .otherwise(repair(t)),
    )


def _item_marks(tokens: Column) -> Column:
    """``(at, opens)`` of the tags that open or close an item, in order, by one pass over the tokens."""
    opens = lambda t: F.when(F.regexp_like(t, F.lit(_OPEN)), F.lit(True)).when(F.regexp_like(t, F.lit(_CLOSE)), F.lit(False))
    marks = F.transform(tokens, lambda t, i: F.struct((i + 1).alias("at"), opens(t).alias("opens")))
    return F.filter(marks, lambda m: m["opens"].isNotNull())


def _item_spans(marks: Column) -> Column:
    """``(at, end)`` of the items that close before the next one opens: the mark behind the opening one closes."""
    pairs = F.transform(marks, lambda m, k: F.struct(m.alias("mark"), F.get(marks, k + 1).alias("behind")))
    whole = F.filter(pairs, lambda p: p["mark"]["opens"] & ~p["behind"]["opens"])
    return F.transform(whole, lambda p: F.struct(p["mark"]["at"].alias("at"), p["behind"]["at"].alias("end")))


def unclosed_items(rss: Column) -> Column:
    """How many items the feed opens and does not close, by tags outside comments and CDATA."""
    return bind(_item_marks(feed_tokens(rss)), lambda marks: F.size(F.filter(marks, lambda m: m["opens"])) - F.size(_item_spans(marks)))


def feed_item_texts(rss: Column) -> Column:
    """The text of each ``<item>`` of a feed, ready for XML, by a scan of its markup.

    Items are cut at tags only: ``<item>`` inside a comment or a CDATA section is text, and an item
    inside a comment is no item. HTML entities become character references and bare ampersands
    are escaped, outside CDATA sections only. An item that is opened and not closed before the
    next one opens is left out (``unparsed_snapshots`` lists its feed). Items are told apart before
    they are parsed, so a fault in one of them, or in the channel around them, costs no other.
    The scan runs once per feed, and its work grows with the feed's length.
    """

    def texts(tokens: Column) -> Column:
        cut = lambda s: F.array_join(F.slice(tokens, s["at"], s["end"] - s["at"] + 1), "")
        return bind(_item_marks(tokens), lambda marks: F.transform(_item_spans(marks), cut))

    return F.coalesce(bind(feed_tokens(rss), texts), F.array().cast("array<string>"))


def ad_key(title: Column, published: Column, updated: Column | None = None) -> Column:
    """Key of an advert, or of one update of it; null if a part is missing."""
    parts = [title, F.lit("___"), published]
    if updated is not None:
        parts += [F.lit("___"), updated]
    return F.concat(*parts)
