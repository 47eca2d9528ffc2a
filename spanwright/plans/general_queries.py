"""Queries over a grammar with unary chains and rules of three symbols, over the events' sentences, and over trees of any arity from the orders.

The mixed grammar has the ambiguous one's rules, of lesser weight, a pair of unary rules that turn X into Y and back, one from the
start, and a rule of three for each nonterminal. An order's tree has a node for each run of lines of one return flag, with a leaf
for each line.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.operators import general as GG
from spanwright.operators import nary
from spanwright.operators.lineage import cut
from spanwright.plans import grammar_queries as E
from spanwright.plans import induction_queries as A

#: Share of the ambiguous grammar's rules; the unary rule's child and weight; the rule of three's children and weight.
MIXED = {"S": (0.7, "X", 0.1, ["X", "Y", "X"], 0.2), "X": (0.6, "Y", 0.2, ["Y", "X", "Y"], 0.2), "Y": (0.5, "X", 0.3, ["X", "X", "Y"], 0.2)}
FACTOR = 5.0


def mixed(spark, sf):
    """(lhs, rhs, p)."""
    share = spark.createDataFrame([(a, x[0]) for a, x in MIXED.items()], "lhs string, share double")
    more = spark.createDataFrame([(a, [x[1]], x[2]) for a, x in MIXED.items()] + [(a, x[3], x[4]) for a, x in MIXED.items()], "lhs string, rhs array<string>, p double")
    old = GG.from_binary(A.ambiguous(spark, sf)).join(share, "lhs")
    return cut(old.select("lhs", "rhs", (F.col("p") * F.col("share")).alias("p")).unionByName(more))


def _shown(rules, *values, digits=6):
    return rules.select("lhs", F.array_join("rhs", " ").alias("rhs"), *(F.round(v, digits).alias(v) for v in values))


def unary_inside(spark, sf):
    return GG.inside_log_probability(mixed(spark, sf), A._sents(spark, sf)).select("user_id", "chunk", F.round("lp", 9).alias("lp"))


def unary_rule_counts(spark, sf):
    return _shown(GG.expected_counts(mixed(spark, sf), A._sents(spark, sf)).where("lhs IS NOT NULL"), "n")


def general_em_round(spark, sf):
    """A round of EM; its objective is that of the new weights."""
    return _shown(GG.em(mixed(spark, sf), A._sents(spark, sf), rounds=1).rules, "p")


def variational_round(spark, sf):
    """Weights of a variational M-step with half a count added to every rule."""
    g = mixed(spark, sf)
    return _shown(GG.m_step(g, GG.expected_counts(g, A._sents(spark, sf)), 0.5, True), "p", digits=4)


def entropic_round(spark, sf):
    return _shown(GG.entropic(mixed(spark, sf), A._sents(spark, sf), FACTOR, rounds=1).rules, "p")


def entropic_objective(spark, sf):
    """Of two rounds without an entropy term and two with one: log probability less the term, which never falls."""
    g, s = mixed(spark, sf), A._sents(spark, sf)
    rows = [(factor, k, v) for factor in (0.0, 50.0) for k, v in enumerate(GG.entropic(g, s, factor, rounds=2).objective)]
    return spark.createDataFrame(rows, "factor double, round int, objective double").select("factor", "round", F.round("objective", 6).alias("objective"))


def order_trees(spark, sf):
    """(o_orderkey, value): bracket text of each order's tree."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # line numbers repeat
    w = Window.partitionBy("l_orderkey").orderBy(*order)  # a few lines an order
    x = E._t(spark, sf, "lineitem").withColumn("new", (F.lag("l_returnflag").over(w).eqNullSafe(F.col("l_returnflag"))).cast("int"))
    x = x.withColumn("run", F.sum(1 - F.col("new")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    leaf = F.concat(F.lit("(Q"), F.floor(F.col("l_quantity") / 10).cast("string"), F.lit(" "), F.lower("l_linestatus"), F.lit(")"))
    runs = x.groupBy("l_orderkey", "run", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct(*order, leaf.alias("leaf")))).alias("x"))
    runs = runs.select("l_orderkey", "run", F.concat(F.lit("("), "l_returnflag", F.lit(" "), F.array_join(F.transform("x", lambda y: y["leaf"]), " "), F.lit(")")).alias("part"))
    own = runs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("run", "part"))).alias("x"))
    return own.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("(S "), F.array_join(F.transform("x", lambda y: y["part"]), " "), F.lit(")")).alias("value"))


def order_rules(spark, sf):
    return nary.rules_of(nary.productions(order_trees(spark, sf)))


def binarised_rules(spark, sf):
    """The orders' grammar in binary rules, over both kinds of shared symbols."""
    g = cut(order_rules(spark, sf))
    both = [GG.binarised(g, side).withColumn("side", F.lit(side)) for side in ("left", "right")]
    x = both[0].unionByName(both[1])
    return x.select("side", "lhs", F.array_join("rhs", " ").alias("rhs"), F.round("p", 9).alias("p"))


def binarised_round_trip(spark, sf):
    """Each order's binary tree under the binary grammar, whether undoing it gives the tree back, and its number of inner nodes. Equal trees are read once."""
    t = cut(order_trees(spark, sf))
    forms = cut(t.groupBy("value").agg(F.count(F.lit(1)).alias("times")))
    rules = GG.binarised(nary.rules_of(nary.productions(forms.select("times", "value")), "times"), "right")
    two = cut(nary.mapped(forms.select("value"), nary.binarised, "value", "two"))
    back = nary.mapped(two, nary.unbinarised, "two", "back").select("value", (F.col("back") == F.col("value")).alias("same"))
    prods = cut(nary.productions(two, "two"))
    n = prods.groupBy("value").agg(F.count(F.lit(1)).alias("n_nodes"))
    scored = nary.log_weights(prods, rules, ["value"]).join(back, "value").join(n, "value")
    return t.join(scored, "value").select("o_orderkey", F.round("lp", 9).alias("lp"), "same", "n_nodes")


QUERIES = {
    "general_rules": lambda sp, sf: _shown(mixed(sp, sf), "p", digits=9),
    "unary_inside": unary_inside,
    "unary_rule_counts": unary_rule_counts,
    "general_em_round": general_em_round,
    "variational_round": variational_round,
    "entropic_round": entropic_round,
    "entropic_objective": entropic_objective,
    "binarised_rules": binarised_rules,
    "binarised_round_trip": binarised_round_trip,
}

_ON = "user_id = {o}.user_id AND {x}.chunk = {o}.chunk"
_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows) + ")"
#: The mixed grammar by kinds of rules; chains of unary rules are followed one by one until nothing is left of them.
_G = f""", sh AS (SELECT * FROM {_VALUES([(a, x[0]) for a, x in MIXED.items()])} t(a, share)),
lx AS MATERIALIZED (SELECT lhs, r1 AS word, p * share AS p FROM g JOIN sh ON a = lhs WHERE r2 IS NULL), b2 AS MATERIALIZED (SELECT lhs, r1, r2, p * share AS p FROM g JOIN sh ON a = lhs WHERE r2 IS NOT NULL),
un AS MATERIALIZED (SELECT * FROM {_VALUES([(a, x[1], x[2]) for a, x in MIXED.items()])} t(lhs, r1, p)), b3 AS MATERIALIZED (SELECT * FROM {_VALUES([(a, *x[3], x[4]) for a, x in MIXED.items()])} t(lhs, r1, r2, r3, p)),
cl AS MATERIALIZED (WITH RECURSIVE ch(a, b, v, k) AS (SELECT a, a, 1.0::DOUBLE, 0 FROM sh UNION ALL SELECT ch.a, un.r1, ch.v * un.p, k + 1 FROM ch JOIN un ON un.lhs = ch.b WHERE k < 80) SELECT a, b, sum(v) AS v FROM ch GROUP BY a, b),
sx AS MATERIALIZED (SELECT user_id, chunk, pos AS i, word, count(*) OVER (PARTITION BY user_id, chunk) AS n FROM lv0), sn AS MATERIALIZED (SELECT user_id, chunk, max(n) AS n FROM sx GROUP BY ALL)"""


def _at(name: str, x: str, start: str, *symbols: str) -> str:
    """A join to span table ``name`` as ``x`` of the same sentence, from ``start`` on."""
    return f" JOIN {name} {x} ON {x}.user_id = o.user_id AND {x}.chunk = o.chunk AND {x}.i = {start} AND " + " AND ".join(f"{x}.{c} = {s}" for c, s in zip("ab", symbols))


def _sum(name: str, parts: list[str], chains: str = "") -> str:
    """Spans (and with ``chains`` their unary closure) as a table."""
    keys = "user_id, chunk, i" + ("" if chains else ", a, b")
    out, join = {"up": (", cl.a AS a", " JOIN cl ON cl.b = x.a"), "down": (", cl.b AS a", " JOIN cl ON cl.a = x.a"), "": ("", "")}[chains]
    return f", {name} AS MATERIALIZED (SELECT {keys}{out}, sum({'x.v * cl.v' if chains else 'v'}) AS v FROM ({' UNION ALL '.join(parts)}) x{join} GROUP BY ALL)"


def _inside() -> str:
    """c: what spans of a width hold; d: neighbouring pairs in spans of a width."""
    out = ""
    for w in range(1, E.LENGTH + 1):
        if w > 1:
            out += _sum(f"d{w}", [f"SELECT o.user_id, o.chunk, o.i, o.a AS a, y.a AS b, o.v * y.v AS v FROM c{k} o JOIN c{w - k} y ON y.user_id = o.user_id AND y.chunk = o.chunk AND y.i = o.i + {k}" for k in range(1, w)])
        parts = ["SELECT user_id, chunk, i, lhs AS a, p AS v FROM sx JOIN lx ON lx.word = sx.word"] if w == 1 else [f"SELECT user_id, chunk, i, lhs AS a, v * p AS v FROM d{w} JOIN b2 ON r1 = a AND r2 = b"]
        parts += [f"SELECT o.user_id, o.chunk, o.i, b3.lhs AS a, o.v * y.v * b3.p AS v FROM d{k} o JOIN b3 ON b3.r1 = o.a AND b3.r2 = o.b{_at(f'c{w - k}', 'y', f'o.i + {k}', 'b3.r3')}" for k in range(2, w)]
        out += _sum(f"c{w}", parts, "up")
    tops = " UNION ALL ".join(f"SELECT user_id, chunk, {w} AS n, v FROM c{w} WHERE i = 0 AND a = 'S'" for w in range(1, E.LENGTH + 1))
    return out + f", tops AS ({tops}), z AS MATERIALIZED (SELECT sn.user_id, sn.chunk, sn.n, v AS z FROM sn JOIN tops ON tops.user_id = sn.user_id AND tops.chunk = sn.chunk AND tops.n = sn.n WHERE v > 0)"


def _outside() -> str:
    """q: what stands around a symbol, over the sentence's weight, before unary rules expand it; e: what stands around the first two symbols of a rule of three; then the rules' uses."""
    out = ""
    for w in range(E.LENGTH, 0, -1):
        parts = [f"SELECT user_id, chunk, 0 AS i, 'S' AS a, 1 / z AS v FROM z WHERE n = {w}"]
        for wide in range(w + 1, E.LENGTH + 1):
            k = wide - w
            two, three = f"FROM q{wide} o JOIN b2 ON b2.lhs = o.a", f"FROM q{wide} o JOIN b3 ON b3.lhs = o.a"
            parts.append(f"SELECT o.user_id, o.chunk, o.i, b2.r1, o.v * b2.p * y.v {two}{_at(f'c{k}', 'y', f'o.i + {w}', 'b2.r2')}")
            parts.append(f"SELECT o.user_id, o.chunk, o.i + {k}, b2.r2, o.v * b2.p * y.v {two}{_at(f'c{k}', 'y', 'o.i', 'b2.r1')}")
            if k > 1:
                parts.append(f"SELECT o.user_id, o.chunk, o.i, b3.r1, o.v * b3.p * y.v {three}{_at(f'd{k}', 'y', f'o.i + {w}', 'b3.r2', 'b3.r3')}")
                parts.append(f"SELECT o.user_id, o.chunk, o.i + {k}, b3.r3, o.v * b3.p * y.v {three}{_at(f'd{k}', 'y', 'o.i', 'b3.r1', 'b3.r2')}")
        # the middle child: around the first two symbols of a rule, beside the first of them
        parts += [f"SELECT o.user_id, o.chunk, o.i + {m}, o.b, o.v * y.v FROM e{w + m} o{_at(f'c{m}', 'y', 'o.i', 'o.a')}" for m in range(1, E.LENGTH - w)]
        out += _sum(f"q{w}", parts, "down")
        if w > 1:  # around the first two symbols of a rule of three that span w words
            around = [f"SELECT o.user_id, o.chunk, o.i, b3.r1 AS a, b3.r2 AS b, o.v * b3.p * y.v AS v FROM q{wide} o JOIN b3 ON b3.lhs = o.a{_at(f'c{wide - w}', 'y', f'o.i + {w}', 'b3.r3')}" for wide in range(w + 1, E.LENGTH + 1)]
            out += _sum(f"e{w}", around or ["SELECT user_id, chunk, 0 AS i, '' AS a, '' AS b, 0.0::DOUBLE AS v FROM z WHERE false"])
    uses = ["SELECT o.a AS lhs, sx.word AS rhs, o.v * lx.p AS n FROM q1 o JOIN sx ON sx.user_id = o.user_id AND sx.chunk = o.chunk AND sx.i = o.i JOIN lx ON lx.lhs = o.a AND lx.word = sx.word"]
    for w in range(1, E.LENGTH + 1):
        uses.append(f"SELECT o.a, un.r1, o.v * un.p * y.v FROM q{w} o JOIN un ON un.lhs = o.a{_at(f'c{w}', 'y', 'o.i', 'un.r1')}")
        if w > 1:
            uses.append(f"SELECT o.a, b2.r1 || ' ' || b2.r2, o.v * b2.p * x.v FROM q{w} o JOIN b2 ON b2.lhs = o.a{_at(f'd{w}', 'x', 'o.i', 'b2.r1', 'b2.r2')}")
        uses += [f"SELECT o.a, b3.r1 || ' ' || b3.r2 || ' ' || b3.r3, o.v * b3.p * x.v * y.v FROM q{w} o JOIN b3 ON b3.lhs = o.a{_at(f'd{k}', 'x', 'o.i', 'b3.r1', 'b3.r2')}{_at(f'c{w - k}', 'y', f'o.i + {k}', 'b3.r3')}" for k in range(2, w)]
    return out + f", uses AS MATERIALIZED (SELECT lhs, rhs, sum(n) AS n FROM ({' UNION ALL '.join(uses)}) GROUP BY ALL), gr AS (SELECT lhs, word AS rhs, p FROM lx UNION ALL SELECT lhs, r1, p FROM un UNION ALL SELECT lhs, r1 || ' ' || r2, p FROM b2 UNION ALL SELECT lhs, r1 || ' ' || r2 || ' ' || r3, p FROM b3)"


_IN = _G + _inside()
_OUT = _IN + _outside()
#: psi as a slope of lgamma, which is no series.
_PSI = lambda x: f"((lgamma({x} + 0.0001) - lgamma({x} - 0.0001)) / 0.0002)"
_TREES = """WITH li AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_returnflag AS f, 'Q' || floor(l_quantity / 10)::BIGINT AS q, lower(l_linestatus) AS s FROM lineitem),
ru AS (SELECT *, sum(CASE WHEN f = pf THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY n) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY k ORDER BY n) AS pf FROM li)),
rn AS (SELECT k, run, f, list(q ORDER BY n) AS kids FROM ru GROUP BY k, run, f),
pr AS (SELECT k, 'S' AS lhs, list(f ORDER BY run) AS rhs FROM rn GROUP BY k UNION ALL SELECT k, f, kids FROM rn UNION ALL SELECT k, q, [s] FROM li),
og AS (SELECT lhs, rhs, count(*) / sum(count(*)) OVER (PARTITION BY lhs) AS p FROM pr GROUP BY lhs, rhs)"""
_J = "list_aggregate({}, 'string_agg', '|')".format
_STEPS = lambda name, inner: f"SELECT DISTINCT '{name}' AS side, {inner} FROM og, LATERAL (SELECT unnest(range(2, len(rhs)::BIGINT)) AS k) WHERE len(rhs) > 2"
ORACLES = {
    "general_rules": A._q("SELECT lhs, word AS rhs, round(p, 9) AS p FROM lx UNION ALL SELECT lhs, r1 || ' ' || r2, round(p, 9) FROM b2 UNION ALL SELECT lhs, r1, round(p, 9) FROM un UNION ALL SELECT lhs, r1 || ' ' || r2 || ' ' || r3, round(p, 9) FROM b3", _G),
    "unary_inside": A._q("SELECT sn.user_id, sn.chunk, round(ln(z), 9) AS lp FROM sn LEFT JOIN z ON z.user_id = sn.user_id AND z.chunk = sn.chunk", _IN),
    "unary_rule_counts": A._q("SELECT lhs, rhs, round(n, 6) AS n FROM uses", _OUT),
    "general_em_round": A._q("SELECT lhs, rhs, round(n / sum(n) OVER (PARTITION BY lhs), 6) AS p FROM uses WHERE n > 0", _OUT),
    "variational_round": A._q(
        f"SELECT lhs, rhs, round(exp({_PSI('m')} - {_PSI('t')}), 4) AS p FROM (SELECT *, sum(m) OVER (PARTITION BY lhs) AS t FROM (SELECT gr.lhs, gr.rhs, coalesce(n, 0) + 0.5 AS m FROM gr LEFT JOIN uses ON uses.lhs = gr.lhs AND uses.rhs = gr.rhs))", _OUT),
    "entropic_round": A._q(
        "SELECT lhs, rhs, round(w * (s + l) / sum(w * (s + l)) OVER (PARTITION BY lhs), 6) AS p FROM (SELECT *, greatest(0, -min(s) OVER (PARTITION BY lhs)) AS l FROM "
        f"(SELECT gr.lhs, gr.rhs, gr.p AS w, coalesce(n, 0) / gr.p + {FACTOR} * (ln(gr.p) + 1) AS s FROM gr LEFT JOIN uses ON uses.lhs = gr.lhs AND uses.rhs = gr.rhs)) WHERE s + l > 0", _OUT),
    "binarised_rules": f"""{_TREES}
SELECT side, lhs, rhs, round(p, 9) AS p FROM (
SELECT side, lhs, list_aggregate(rhs, 'string_agg', ' ') AS rhs, p FROM og, (VALUES ('left'), ('right')) t(side) WHERE len(rhs) <= 2
UNION ALL SELECT 'left', lhs, {_J("rhs[1:len(rhs) - 1]")} || ' ' || rhs[len(rhs)], p FROM og WHERE len(rhs) > 2
UNION ALL SELECT 'right', lhs, rhs[1] || ' ' || {_J("rhs[2:len(rhs)]")}, p FROM og WHERE len(rhs) > 2
UNION ALL {_STEPS("left", f"{_J('rhs[1:k]')} AS lhs, {_J('rhs[1:k - 1]')} || ' ' || rhs[k] AS rhs, 1.0::DOUBLE AS p")}
UNION ALL {_STEPS("right", f"{_J('rhs[k:len(rhs)]')} AS lhs, rhs[k] || ' ' || {_J('rhs[k + 1:len(rhs)]')} AS rhs, 1.0::DOUBLE AS p")})""",
    "binarised_round_trip": f"{_TREES} SELECT k AS o_orderkey, round(sum(ln(p)), 9) AS lp, true AS same, sum(greatest(1, len(pr.rhs) - 1))::BIGINT AS n_nodes FROM pr JOIN og ON og.lhs = pr.lhs AND og.rhs = pr.rhs GROUP BY k",
}
