"""SQL predicates on chunk rows."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.jsonx import rewrite_arrows

MAX_PREDICATE_CHARS = 1000
# Texts a predicate makes: the longest padding, and the longest replacement.
MAX_PADDING = 10_000
MAX_REPLACEMENT = 100

# A quoted text or name.  Spark's texts may hold escaped quotes.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", re.DOTALL)
_COMMENT = re.compile(r"--|/\*|\*/")
_RAW_TEXT = re.compile(r"(?i)\br['\"]")

# What the parser may make of a predicate.  Everything else is refused: sub-queries, windows, aggregates,
# lambdas, parameters, stars and whatever else there is.
NODES = set(
    """
    Literal UnresolvedAttribute UnresolvedFunction UnresolvedExtractValue And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan
    GreaterThanOrEqual In IsNull IsNotNull Like ILike RLike LikeAny LikeAll NotLikeAny NotLikeAll Add Subtract Multiply Divide IntegralDivide
    Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot Concat CaseWhen Cast Substring StringTrim StringTrimLeft
    StringTrimRight StringLocate
    """.split()
)
# What a predicate may call: numbers, texts, JSON fields, lists, times.
FUNCTIONS = set(
    """
    abs ceil ceiling floor round bround sign sqrt pow power mod pmod least greatest isnan nvl ifnull nullif coalesce if isnull isnotnull
    length char_length character_length octet_length lower lcase upper ucase trim ltrim rtrim btrim substring substr left right
    instr locate position startswith endswith contains concat concat_ws replace translate reverse repeat lpad rpad split regexp_like
    regexp_count regexp_extract regexp_replace initcap ascii levenshtein md5 sha2 crc32 xxhash64 hash
    get_json_object json_array_length
    between array array_contains array_position array_size arrays_overlap array_min array_max size cardinality element_at get
    cast try_cast int bigint double float string boolean date timestamp
    year month day dayofmonth hour minute second to_date to_timestamp date_trunc trunc date_add date_sub datediff unix_timestamp extract
    """.split()
)


class QueryError(ValueError):
    """A request the engine refuses."""


# Functions whose result may be much longer than their arguments, and the argument that bounds it.
_GROWING = {"repeat": 1, "lpad": 1, "rpad": 1, "replace": 2, "regexp_replace": 2}


def _refuse_unknown(spark: SparkSession, predicate: str) -> None:
    """Refuse everything but expressions over columns and known functions.

    The predicate is parsed, not analysed, so that a refused one has not looked at any file.
    """
    if _RAW_TEXT.search(_QUOTED.sub(lambda m: m[0][0] + m[0][-1], predicate)):
        raise QueryError("raw texts are not allowed in a predicate")
    if _COMMENT.search(_QUOTED.sub(" ", predicate)):
        raise QueryError("comments are not allowed in a predicate")
    nodes = [(spark._jsparkSession.sessionState().sqlParser().parseExpression(predicate), False)]
    while nodes:
        node, growing = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise QueryError(f"{kind} is not allowed in a predicate")
        children = [node.children().apply(i) for i in range(node.children().size())]
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".").lower()
            if name not in FUNCTIONS:
                raise QueryError(f"function {name} is not allowed in a predicate")
            if name in _GROWING:
                _refuse_growth(name, children, growing)
                growing = True
        nodes += [(child, growing) for child in children]


def _refuse_growth(name: str, arguments: list, nested: bool) -> None:
    """Long texts must not be made, and not be made longer again."""
    if nested:
        raise QueryError(f"{name} is not allowed inside another function that makes texts longer")
    if len(arguments) <= _GROWING[name]:
        return
    bound = arguments[_GROWING[name]]
    value = bound.value() if bound.getClass().getSimpleName() == "Literal" else None
    if name in ("replace", "regexp_replace"):
        if value is None or len(value.toString()) > MAX_REPLACEMENT:
            raise QueryError(f"the replacement of {name} must be a text of at most {MAX_REPLACEMENT} characters")
    elif not isinstance(value, int) or value > MAX_PADDING:
        raise QueryError(f"the length of {name} must be a number up to {MAX_PADDING}")


def where(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows matching a SQL predicate; None or empty keeps all.

    The predicate may use comparison, string, list, range, boolean and JSON
    ``->>`` operators and the functions of ``FUNCTIONS``, but no sub-query, join,
    window, comment or raw text.
    """
    if not predicate:
        return df
    return df.where(predicate_column(df, predicate))


def predicate_column(df: DataFrame, predicate: str | None) -> Column:
    """The predicate over rows of ``df`` as a Column; None or empty is true."""
    if not predicate:
        return F.lit(True)
    if len(predicate) > MAX_PREDICATE_CHARS:
        raise QueryError(f"predicate longer than {MAX_PREDICATE_CHARS} characters")
    rewritten = rewrite_arrows(predicate)
    try:
        _refuse_unknown(df.sparkSession, rewritten)
        column = F.expr(rewritten)
        df.where(column)
    except (AnalysisException, ParseException) as exc:
        raise QueryError(f"query error: {exc}") from exc
    return column
