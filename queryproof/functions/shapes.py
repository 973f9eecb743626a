"""The shape of a statement from facts about its text.

The text is prepared once per row: blanks around operators, the part outside all parentheses, the parts
inside, the sources of the outermost query with their alias, and its clauses. Shapes are then told apart by
these facts; nothing is searched with back-tracking patterns over whole statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryproof.functions.rules import first_match
from queryproof.functions.text import collapse

# Words that begin a clause after the sources of a query.
CLAUSES = ("where", "group by", "having", "order by", "limit", "offset", "fetch", "union")
# Words that can't be an alias.
RESERVED = ("where", "group", "having", "order", "limit", "offset", "fetch", "union", "on", "join", "left", "right",
            "inner", "full", "cross", "as", "using", "natural")
# Fixed value: a limit from here on takes everything.
LARGE_LIMIT = 1_000_000

NAME = "^[a-z_][a-z0-9_]*$"
PATH = "^[a-z_][a-z0-9_.]*$"


def outside_parentheses(text: Column) -> Column:
    """The text with the contents of all parentheses left out, in one pass with a running depth."""
    pieces = F.regexp_extract_all(text, F.lit(r"([()]|[^()]+)"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        opened, closed = piece == "(", piece == ")"
        shown = F.when(opened & (state["depth"] == 0), "(").when(closed & (state["depth"] == 1), ")")
        shown = shown.when(~opened & ~closed & (state["depth"] == 0), piece).otherwise("")
        depth = state["depth"] + F.when(opened, 1).when(closed & (state["depth"] > 0), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(state["kept"], shown).alias("kept"))

    return F.aggregate(pieces, start, step, lambda state: state["kept"])


def part(text: Column, mark: str, which: int) -> Column:
    """A piece of the text cut at a plain mark: 1 the first, -1 the last; the empty text where there is none."""
    return F.coalesce(F.try_element_at(F.split(text, rf"\Q{mark}\E"), F.lit(which)), F.lit(""))


def after(text: Column, mark: str) -> Column:
    """What follows the first place of a plain mark."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text))).otherwise("")


def with_text_facts(df: DataFrame, sql: str) -> DataFrame:
    """The working columns ``_text, _spaced, _top, _inside, _sources, _rest, _alias`` of a statement column."""
    text = F.lower(collapse(F.coalesce(F.col(sql), F.lit(""))))
    spaced = F.regexp_replace(F.regexp_replace("_text", r"(<>|!=|(?<![<>!])=|[(),])", " $1 "), " +", " ")
    clause = rf" (?=(?:{'|'.join(CLAUSES)})\b)"
    source = after(F.col("_top"), " from ")
    words = F.split(F.trim(F.regexp_replace("_sources", r"\(\s*\)", "")), " +")
    first = F.when(F.col("_sources").startswith("("), 1).otherwise(2)
    second = F.try_element_at(words, first)
    named = F.when(second == "as", F.try_element_at(words, first + 1)).otherwise(second)
    return (
        df.withColumn("_text", text)
        .withColumn("_spaced", F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")))
        .withColumn("_top", F.trim(F.when(says(F.col("_text"), "("), outside_parentheses(F.col("_text"))).otherwise(F.col("_text"))))
        .withColumn("_inside", after(F.col("_text"), "("))
        .withColumn("_sources", F.trim(F.element_at(F.split(source, clause, 2), 1)))
        .withColumn("_rest", F.trim(F.coalesce(F.try_element_at(F.split(source, clause, 2), F.lit(2)), F.lit(""))))
        .withColumn("_alias", F.when(named.rlike(NAME) & ~named.isin(*RESERVED), named).otherwise(""))
    )


FACTS = ("_text", "_spaced", "_top", "_inside", "_sources", "_rest", "_alias")


def rest_of(items: Column) -> Column:
    """An array without its first item."""
    return F.slice(items, F.lit(2), F.size(items))


def any_part(text: Column, mark: str, test) -> Column:
    """Whether ``test`` holds for what follows any place of a plain mark; cheap where there is none."""
    return F.contains(text, F.lit(mark)) & F.exists(rest_of(F.split(text, rf"\Q{mark}\E")), test)


def same_column_alternatives(spaced: Column) -> Column:
    """``c = x or c = y``: two neighbours of an OR test the same column."""
    plain = F.regexp_replace(spaced, "'[^']*'", "'v'")
    sides = F.transform(F.split(plain, " or "), lambda s: F.split(F.trim(s), " "))
    ends = F.transform(sides, lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3)))
    starts = rest_of(F.transform(sides, lambda w: F.slice(w, 1, 2)))

    def same(end: Column, start: Column) -> Column:
        column = F.try_element_at(end, F.lit(1))
        found = (F.try_element_at(end, F.lit(2)) == "=") & (F.try_element_at(start, F.lit(2)) == "=")
        return F.coalesce(found & (column == F.try_element_at(start, F.lit(1))) & column.rlike(PATH), F.lit(False))

    return F.exists(F.zip_with(ends, starts, same), lambda found: found)


def reads_itself(spaced: Column, sources: Column) -> Column:
    """A test whether a row of the query's own table exists with the same id: both sides of the first equality
    inside name the column ``id``, and the table inside is the table outside."""
    words = F.split(F.trim(after(spaced, " exists ( select ")), " ")
    table = F.try_element_at(words, F.array_position(words, "from").cast("int") + 1)
    equal = F.array_position(words, "=").cast("int")
    sides = [F.try_element_at(words, F.when(equal > 1, equal + step)) for step in (-1, 1)]
    ids = [F.element_at(F.split(side, r"\."), -1) == "id" for side in sides]
    last = F.try_element_at(words, F.when(equal > 1, equal + 2)) == ")"
    own = F.element_at(F.split(F.trim(sources), " "), 1)
    return says(spaced, " where exists ( select ") & F.coalesce((table == own) & ids[0] & ids[1] & last, F.lit(False))


def is_literal(item: Column) -> Column:
    """Nothing but a number, NULL or one quoted text."""
    def quoted_by(q: str) -> Column:
        return (F.length(item) > 1) & item.startswith(q) & item.endswith(q) & (F.size(F.split(item, q)) == 3)

    return (item == "null") | item.try_cast("decimal(38,10)").isNotNull() | quoted_by("'") | quoted_by('"')


def folds_numbers(text: Column) -> Column:
    """Whole numbers on both sides of an arithmetic sign."""
    words = F.split(F.trim(F.regexp_replace(F.translate(text, "(),", "   "), r"([-+*/])", " $1 ")), " +")
    kinds = F.transform(words, lambda w: F.when(w.isin("+", "-", "*", "/"), "o").when(w.try_cast("decimal(38,0)").isNotNull() & ~F.contains(w, F.lit(".")), "n").otherwise("x"))
    return F.contains(F.array_join(kinds, ""), F.lit("non"))


def says(text: Column, *phrases: str) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def shape_family(features: Column) -> Column:
    """First matching of 29 shapes over the facts of ``with_text_facts``; dynamic shapes come first."""
    text, spaced, top, inside = (F.col(c) for c in ("_text", "_spaced", "_top", "_inside"))
    sources, rest, alias = (F.col(c) for c in ("_sources", "_rest", "_alias"))

    def has(*names: str) -> Column:
        return F.size(F.array_intersect(features, F.array(*map(F.lit, names)))) == len(names)

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(features, F.array(*map(F.lit, names)))

    static = F.size(features) == 0
    only_include = (F.size(features) == 1) & has("INCLUDE")
    guarded = has("WHERE", "IF")
    counts_rows = top.rlike(r"^select count ?\( ?\) from ?\(")

    outer, whole_inside = top.startswith("select "), inside.startswith("select ") | says(inside, "(select ", "( select ")
    alone = ~says(sources, " join ", ",")
    wraps = outer & alone & sources.startswith("(") & whole_inside
    ends_plainly = (rest == "") | rest.rlike("^(order by|limit|offset|fetch)")
    # The outermost query reads one table under one short name and says so.
    one_table = outer & alone & ~sources.startswith("(")
    qualified = one_table & (alias != "") & F.contains(text, F.concat(alias, F.lit(".")))
    last_order = F.when(says(text, " order by "), part(text, " order by ", -1)).otherwise("")
    last_limit = F.when(says(text, " limit "), part(text, " limit ", -1)).otherwise("")
    list_head = lambda tail: says(tail, " ) ") & ~says(part(tail, " ) ", 1), " , ")
    tested = F.when(says(spaced, " where "), after(spaced, " where ")).otherwise("")

    def two_paths(tail: Column) -> Column:
        given = F.split(part(tail, " ) ", 1), " , ")
        return (F.size(given) == 2) & F.element_at(given, 1).rlike(PATH) & F.try_element_at(given, F.lit(2)).rlike(PATH)

    projections = F.split(F.regexp_replace(part(top, " from ", 1), "^select ", ""), " ?, ?")

    def repeats_itself(item: Column) -> Column:
        return F.coalesce(part(part(item, " as ", 1), ".", -1) == F.try_element_at(F.split(item, " as "), F.lit(2)), F.lit(False))

    return first_match(
        [
            (has("FOREACH", "INCLUDE", "WHERE") & any_of("IF", "CHOOSE", "TRIM", "BIND"), "FOREACH_COLLECTION_PREDICATE"),
            (only_include & (F.size(F.split(text, "<include ")) > 2), "MULTI_FRAGMENT_INCLUDE"),
            (guarded & counts_rows & (rest == ""), "IF_GUARDED_COUNT_WRAPPER"),
            (guarded | has("CHOOSE"), "IF_GUARDED_FILTER_STATEMENT"),
            (only_include, "STATIC_INCLUDE_ONLY"),
            (~static, "UNKNOWN"),
            (says(spaced, " over ( "), "WINDOW"),
            (is_literal(last_order), "ORDER_BY_CONSTANT"),
            (says(spaced, " where 1 = 1 ", " where 0 = 0 ", " where true "), "BOOLEAN_TAUTOLOGY"),
            (any_part(tested, " in ( ", list_head), "IN_LIST_SINGLE_VALUE"),
            (says(spaced, " or ") & same_column_alternatives(spaced), "OR_SAME_COLUMN"),
            (says(spaced, " case when true then "), "CASE_WHEN_TRUE"),
            (any_part(spaced, " coalesce ( ", two_paths), "COALESCE_IDENTITY"),
            (says(text, "+", "-", "*", "/") & folds_numbers(text), "EXPRESSION_FOLDING"),
            (F.coalesce(last_limit.try_cast("decimal(38,0)") >= LARGE_LIMIT, F.lit(False)), "LIMIT_LARGE"),
            (says(spaced, " = null ", " != null ", " <> null "), "NULL_COMPARISON"),
            (says(spaced, " select distinct on ( "), "DISTINCT_ON"),
            (reads_itself(spaced, sources), "EXISTS_SELF"),
            (wraps & (alias != "") & says(inside, " union "), "UNION_WRAPPER"),
            (says(text, "union"), "UNION"),
            (wraps & top.startswith("select distinct ") & says(inside, "select distinct "), "DISTINCT_WRAPPER"),
            (wraps & ends_plainly & says(inside, " having "), "HAVING_WRAPPER"),
            (wraps & ends_plainly & says(inside, " group by "), "GROUP_BY_WRAPPER"),
            (wraps & (ends_plainly | rest.startswith("where")), "STATIC_SUBQUERY_WRAPPER"),
            (qualified & top.startswith("select distinct "), "DISTINCT_ALIAS"),
            (qualified & says(text, " group by ") & says(text, " having "), "GROUP_BY_HAVING_ALIAS"),
            (qualified & says(text, " group by "), "GROUP_BY_ALIAS"),
            (outer & says(top, " as ") & F.exists(projections, repeats_itself), "STATIC_ALIAS_PROJECTION"),
        ],
        "STATIC_STATEMENT",
    )
