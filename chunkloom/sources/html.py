"""Text of HTML pages, without menus.

One expression cuts a page into tokens from its start to its end: comments, raw elements, tags whose
quoted attributes may hold ``>``, entities, and text.  The state that a parser would carry along is a
set of running sums over the tokens of the page: the number of the block, and the depth inside links,
preformatted text, the title, and each of the elements that hold no content.  Depths do not fall below
zero, so a stray end tag changes nothing.  Blocks that consist mostly of link text are menus and are dropped,
headings excepted.  Tokens are shuffled once, by page.

Defined results.  Null or empty page: no blocks, empty text, null title.  Very long pages: any
length; one page is put together in one task.  Unclosed comments and raw elements reach to the end, an
unclosed quote ends its tag at the next ``>``, a lone ``<`` or ``&`` is text, an element without content that is not closed
ends where main content begins (``CONTENT_STARTS``).  Unknown entities stay as written.
Repeated rows are rows of their own.  Other columns are kept; ``title``, ``text``, ``n_blocks`` and ``n_dropped`` must not be among
them unless ``html`` is one of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Element names and entities of HTML.
RAW = "script style textarea xmp iframe noembed noframes".split()
BLOCKS = """
address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul
""".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
WITHOUT_CONTENT = "nav aside footer menu form select button noscript template svg".split()
CONTENT_STARTS = "main article h1".split()
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "euro": "€", "pound": "£", "cent": "¢", "yen": "¥", "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "iexcl": "¡", "iquest": "¿", "shy": "­", "zwnj": "‌",
}

# Share of a block's characters that may be link text.
MOST_LINKED = 0.5

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SPACES = "[\\t\\n\\x0B\\f\\r  ]+"
TOKEN = "|".join(
    [
        r"<!--[\s\S]*?(?:-->|\z)",
        *[rf"<(?i:{name})(?:[\s/]{_ATTRIBUTES})?>[\s\S]*?(?:</(?i:{name})\s*>|\z)" for name in RAW],
        rf"</?[a-zA-Z]{_ATTRIBUTES}>",
        r"</?[a-zA-Z][^>]*+(?:>|\z)",
        r"<[!?/][^>]*+(?:>|\z)",
        r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});",
        r"[^<&]++",
        r"[<&]",
    ]
)


def tokens(html: Column) -> Column:
    """A page as an array of tokens whose concatenation is the page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))


def decoded(entity: Column) -> Column:
    """The character an entity stands for, or the entity as written."""
    body = F.substring(entity, 2, 40)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in (f"{pair[0]};", pair[1])]), body)
    digits = F.regexp_extract(body, "^#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("long")
    sound = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    numeric = F.when(body.startswith("#"), F.when(sound, char).otherwise("�"))
    return F.coalesce(numeric, named, entity)


def _squeezed(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, _SPACES, " "))


def extract(pages: DataFrame, *, html: str = "html", most_linked: float = MOST_LINKED) -> DataFrame:
    """``pages`` with ``html`` replaced by ``title``, ``text``, ``n_blocks`` and ``n_dropped``."""
    others = [c for c in pages.columns if c != html]
    kept = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in others])
    cut = pages.select(
        F.monotonically_increasing_id().alias("page"), kept.alias("kept"), tokens(F.col(f"`{html}`")).alias("tokens")
    ).select("page", "kept", F.posexplode_outer("tokens").alias("pos", "token"))
    # The other columns travel with the first token only.
    cut = cut.withColumn("kept", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("kept")))

    named = cut.withColumn("name", F.lower(F.regexp_extract("token", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1)))
    tag = F.col("token").rlike("^</?[a-zA-Z]")
    closing = F.col("token").startswith("</")
    # A raw element comes as one token and leaves no end tag.
    raw = F.col("name").isin(RAW)
    read = named.select(
        "page",
        "kept",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(tag & ~raw, F.col("name")).otherwise("").alias("name"),
        F.when(tag & ~raw & closing, -1).when(tag & ~raw, 1).otherwise(0).alias("turn"),
        F.when(F.col("token").rlike("^&.+;$"), decoded(F.col("token")))
        .when(~F.col("token").rlike("^<."), F.col("token"))
        .alias("piece"),
    )

    order = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("name").isin(CONTENT_STARTS) & (F.col("turn") == 1)
    numbered = read.withColumns(
        {
            "block": F.sum(F.col("name").isin(BLOCKS).cast("int")).over(order),
            "part": F.sum(starts.cast("int")).over(order),
        }
    )
    # Depths of elements without content start anew where main content begins.
    anew = Window.partitionBy("page", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depths = {name: anew for name in WITHOUT_CONTENT} | {name: order for name in ("a", "pre", "title", *HEADINGS)}
    sums = {f"sum_{name}": F.sum(F.when(F.col("name") == name, F.col("turn")).otherwise(0)).over(w) for name, w in depths.items()}
    lows = {f"low_{name}": F.least(F.min(f"sum_{name}").over(w), F.lit(0)) for name, w in depths.items()}

    def inside(*names: str) -> Column:
        return F.greatest(*[F.col(f"sum_{n}") - F.col(f"low_{n}") for n in names], F.lit(0)) > 0

    placed = numbered.withColumns(sums).withColumns(lows).select(
        "page", "kept", "pos", "block", "piece",
        F.length(F.regexp_replace("piece", _SPACES, "")).alias("chars"),
        inside("a").alias("linked"), inside("pre").alias("pre"), inside("title").alias("title"),
        inside(*HEADINGS).alias("heading"), inside(*WITHOUT_CONTENT).alias("aside"),
    )
    shown = ~F.col("title") & ~F.col("aside")

    def joined(where: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(where, F.struct("pos", "piece"))))["piece"], "")

    blocks = placed.groupBy("page", "block").agg(
        F.first("kept", ignorenulls=True).alias("kept"),
        joined(shown).alias("body"),
        joined(F.col("title")).alias("title"),
        F.coalesce(F.sum(F.when(shown, F.col("chars"))), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.when(shown & F.col("linked"), F.col("chars"))), F.lit(0)).alias("link_chars"),
        F.coalesce(F.sum(F.when(~shown & ~F.col("title"), F.col("chars"))), F.lit(0)).alias("aside_chars"),
        F.max("pre").alias("pre"),
        F.max("heading").alias("heading"),
    )
    menu = (F.col("link_chars") > F.col("chars") * F.lit(most_linked)) & ~F.col("heading")
    told = blocks.select(
        "page", "block", "kept",
        F.nullif(_squeezed(F.col("title")), F.lit("")).alias("title"),
        F.when((F.col("chars") > 0) & ~menu, F.when(F.col("pre"), F.regexp_replace("body", r"\A[\r\n]+|\s+\z", "")).otherwise(_squeezed(F.col("body")))).alias("line"),
        (((F.col("chars") > 0) & menu) | ((F.col("chars") == 0) & (F.col("aside_chars") > 0))).alias("dropped"),
    )
    found = told.groupBy("page").agg(
        F.first("kept", ignorenulls=True).alias("kept"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("block"))).alias("title"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("block", "line"))))["line"], "\n").alias("text"),
        F.count("line").alias("n_blocks"),
        F.count_if("dropped").alias("n_dropped"),
    )
    return found.select(*[F.col(f"kept.`{c}`").alias(c) for c in others], "title", "text", "n_blocks", "n_dropped")
