"""Drain log-template clustering (He et al., ICWS 2017), per service.

A fixed-depth parse tree routes a token sequence by its length and its first
tokens to a leaf; inside the leaf the most similar cluster (share of equal
tokens) absorbs it when the similarity reaches the threshold, turning differing
positions into ``<*>``. Drain is order dependent: each service's distinct
regex templates are fed in order of first appearance, which keeps a group
small (it grows with template variety, not with log volume). The tree splits by
length first and lengths share no node or cluster, so each (service, length) is
a group of its own. The number of clusters has no limit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER

# Fixed values (reference configuration).
SIM_THRESHOLD = 0.4
DEPTH = 4
MAX_CHILDREN = 2000
#: A token as ``str.split`` sees it (Java regex): anything between Unicode blanks.
TOKEN = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


class Drain:
    """A plain-Python Drain tree; used inside one Spark task per service and length."""

    def __init__(self, sim: float = SIM_THRESHOLD, depth: int = DEPTH, max_children: int = MAX_CHILDREN,
                 parametrize_numeric: bool = True):
        self.sim, self.levels = sim, max(1, depth - 2)
        self.max_children = max_children
        self.numeric = parametrize_numeric
        self.root: dict = {}
        self.templates: list[list[str]] = []

    @staticmethod
    def _has_digit(tok: str) -> bool:
        return any(c.isdigit() for c in tok)

    def _leaf(self, tokens: list[str], create: bool) -> list[int] | None:
        node = self.root.setdefault(len(tokens), {}) if create else self.root.get(len(tokens))
        if node is None:
            return None
        for tok in tokens[: self.levels]:
            key = PLACEHOLDER if (self.numeric and self._has_digit(tok)) else tok
            if key in node:
                node = node[key]
            elif not create:
                node = node.get(PLACEHOLDER)
                if node is None:
                    return None
            else:
                if len(node) + 1 >= self.max_children and PLACEHOLDER in node:
                    node = node[PLACEHOLDER]
                elif len(node) + 1 >= self.max_children:
                    node = node.setdefault(PLACEHOLDER, {})
                else:
                    node = node.setdefault(key, {})
        return node.setdefault("__clusters__", []) if create else node.get("__clusters__")

    def _similarity(self, tmpl: list[str], tokens: list[str]) -> tuple[float, int]:
        same = params = 0
        for a, b in zip(tmpl, tokens):
            if a == PLACEHOLDER:
                params += 1
            elif a == b:
                same += 1
        return same / max(1, len(tmpl)), params

    def add(self, message: str) -> tuple[str, int]:
        tokens = message.split()
        leaf = self._leaf(tokens, create=True)
        best, best_key = None, (-1.0, -1)
        for cid in leaf:
            key = self._similarity(self.templates[cid], tokens)
            if key > best_key:
                best, best_key = cid, key
        if best is not None and best_key[0] >= self.sim:
            t = self.templates[best]
            self.templates[best] = [a if a == b else PLACEHOLDER for a, b in zip(t, tokens)]
            return " ".join(self.templates[best]), best + 1
        self.templates.append(list(tokens))
        leaf.append(len(self.templates) - 1)
        return " ".join(tokens), len(self.templates)


def _drain_group(pdf: pd.DataFrame, sim: float, depth: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["first_ts", "first_id"])
    d = Drain(sim, depth)
    out = [d.add(m) for m in pdf["template"]]
    # template at first appearance (as stored then), and the cluster's final form
    finals = {cid: " ".join(d.templates[cid - 1]) for _, cid in out}
    return pd.DataFrame({"service_name": pdf["service_name"].to_numpy(), "template": pdf["template"].to_numpy(),
                         "drain_template": [t for t, _ in out], "cluster_template": [finals[c] for _, c in out],
                         "drain_cluster_id": [f"{n}-{c}" for n, (_, c) in zip(pdf["n_tokens"], out)]})


def drain_templates(entries: DataFrame, sim: float = SIM_THRESHOLD, depth: int = DEPTH,
                    service: str = "service_name", ts: str = "ts", order: str = "log_id") -> DataFrame:
    """LC6: (service_name, template) -> (drain_template, drain_cluster_id).

    Input rows carry the regex ``template`` (LC3). Templates are pre-aggregated
    per service with their first appearance, then one Drain tree per service and
    number of tokens (``applyInPandas``) assigns clusters; join the result back on
    (service_name, template). The cluster id is the number of tokens and the
    cluster's number in its tree; it is unique within the service."""
    first = entries.groupBy(F.col(service).alias("service_name"), "template").agg(
        F.min(F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))).alias("_f"))
    first = first.select("service_name", "template", F.col("_f.t").alias("first_ts"), F.col("_f.o").alias("first_id"),
                         F.regexp_count("template", F.lit(TOKEN)).alias("n_tokens"))
    schema = ("service_name string, template string, drain_template string, cluster_template string, "
              "drain_cluster_id string")
    return first.groupBy("service_name", "n_tokens").applyInPandas(lambda p: _drain_group(p, sim, depth), schema)


def check_templates(mapped: DataFrame) -> DataFrame:
    """Structural check: every template matches its cluster template position by
    position (equal token or ``<*>``) and has the same length."""
    t = F.split("template", " ")
    d = F.split("cluster_template", " ")
    ok = (F.size(t) == F.size(d)) & F.forall(F.arrays_zip(t.alias("a"), d.alias("b")),
                                            lambda z: (z["a"] == z["b"]) | (z["b"] == PLACEHOLDER))
    return mapped.withColumn("matches", ok)
