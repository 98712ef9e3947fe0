"""One query for each rule, and all of them in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fathom.plans.graph_queries import live
from fathom.plans.memo import memo
from fathom.plans.model import project
from fathom.plans.registry import query
from fathom.plans.rule_sql import HEAD, findings_sql
from fathom.plans.rules import Limits, evaluate, facts, rules

#: Members of a driver table are smaller and fewer than those of code.
LIMITS = Limits(method_lines=15, class_methods=8, class_props=4, params=4, lateinit=1, repositories=0, model_methods=6)
CODES = ["DC001", "DC001m", "DC001p", "DC002a", "DC002b", "DC003", "DC005", "DC006", "DC008", "DC009", "AP001", "AP002", "AP003", "AP004", *[f"AP{k:03}" for k in range(7, 35)], "V7", "V9", "V10", "V11"]


def facts_of(spark, sf_dir) -> DataFrame:
    """The facts of all declarations, once a session."""
    code = project(spark, sf_dir)
    return memo(spark, sf_dir, "facts", lambda: facts(code.decls, code.edges, code.roots, live(spark, sf_dir)))


def _one(code):
    @query(f"rule_{code.lower()}", f"{HEAD} {findings_sql(code)}")
    def run(spark, sf_dir):
        return evaluate(facts_of(spark, sf_dir), [r for r in rules(LIMITS) if r.code == code])

    return run


for _code in CODES:
    _one(_code)


@query("all_rules", f"{HEAD} {findings_sql()}")
def all_rules(spark, sf_dir):
    """Every rule at once: one scan of the facts."""
    return evaluate(facts_of(spark, sf_dir), rules(LIMITS))
