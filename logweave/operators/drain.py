"""Template mining: clusters of templates under a fixed-depth prefix tree.

The clustering depends on order, so it runs in Python; but a template only ever
meets templates of its service and token count, so every (service, token count)
is clustered on its own with the result the whole would have.  The input are
templates (one row each), never events.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"
# The placeholders of normalised text.
PLACEHOLDERS = frozenset("<EMAIL> <URL> <UUID> <TIMESTAMP> <IP> <PATH> <HEX> <PORT> <NUM> <TRACE_ID> <OBJECT_ID> <SPAN_ID> <ID>".split())


def is_placeholder(token: str) -> bool:
    return token in PLACEHOLDERS


def branch(token: str) -> str:
    """Branch of a token in the tree: variable tokens share one."""
    return WILDCARD if is_placeholder(token) or any("0" <= c <= "9" for c in token) else token


def same(known: str, token: str) -> bool:
    return known == token or known == WILDCARD or (is_placeholder(known) and (is_placeholder(token) or token == WILDCARD))


@dataclass
class Tree:
    """Clusters of token lists of one length. ``nodes``: branches below a path; ``leaves``: clusters of a path as [tokens, size]."""

    depth: int = 4
    threshold: float = 0.5
    max_children: int = 100
    nodes: dict[tuple, set] = field(default_factory=dict)
    leaves: dict[tuple, list] = field(default_factory=dict)

    def add(self, tokens: list[str]) -> tuple[tuple, int]:
        """Put a token list into its cluster; returns the cluster's (path, number)."""
        path: tuple = ()
        for token in tokens[: max(0, min(self.depth - 2, len(tokens) - 1))]:
            below, b = self.nodes.setdefault(path, set()), branch(token)
            if b not in below and b != WILDCARD and len(below) >= self.max_children:
                b = WILDCARD
            below.add(b)
            path += (b,)
        clusters = self.leaves.setdefault(path, [])
        scores = [sum(map(same, c[0], tokens)) / len(tokens) if tokens else 1.0 for c in clusters]
        best = max(range(len(scores)), key=scores.__getitem__, default=None)
        if best is None or scores[best] < self.threshold:
            clusters.append([list(tokens), 1])
            return path, len(clusters) - 1
        known = clusters[best][0]
        clusters[best] = [[k if same(k, t) and t != WILDCARD else WILDCARD for k, t in zip(known, tokens)], clusters[best][1] + 1]
        return path, best

    def dump(self) -> str:
        return json.dumps([[list(p), sorted(n)] for p, n in self.nodes.items()]) + "\n" + json.dumps([[list(p), c] for p, c in self.leaves.items()])

    def load(self, state: str) -> None:
        """Take over a state; a damaged one is as none."""
        try:
            nodes, leaves = state.split("\n", 1)
            self.nodes = {tuple(p): set(n) for p, n in json.loads(nodes)}
            self.leaves = {tuple(p): [[list(t), int(s)] for t, s in c] for p, c in json.loads(leaves)}
        except (ValueError, TypeError, AttributeError):
            self.nodes, self.leaves = {}, {}


def _cluster(depth: int, threshold: float, max_children: int):
    def run(pdf: pd.DataFrame, state: pd.DataFrame | None = None) -> tuple[pd.DataFrame, Tree]:
        pdf = pdf.sort_values(["event_count", "template_id"], ascending=[False, True], kind="stable")
        tree = Tree(depth, threshold, max_children)
        if state is not None and len(state):
            tree.load(state["state"].iloc[0])
        where = [tree.add(t.split()) for t in pdf["normalized_template"]]
        names = {w: i for i, w in enumerate(dict.fromkeys(where))}
        first = {}
        for w, t in zip(where, pdf["template_id"]):  # the order makes the first one canonical: most events, then smallest id
            first.setdefault(w, t)
        return pdf.assign(cluster_no=[names[w] for w in where], canonical_template_id=[first[w] for w in where], drain_template=[" ".join(tree.leaves[p][i][0]) for p, i in where]), tree

    return run


_OUT = "service_name string, n_tokens int, template_id string, canonical_template_id string, drain_template string, cluster_no int, event_count long"


def mine(templates: DataFrame, state: DataFrame | None = None, depth: int = 4, threshold: float = 0.5, max_children: int = 100) -> DataFrame:
    """Cluster of each template (service_name, template_id, normalized_template, event_count).

    state: (service_name, n_tokens, state) of an earlier run, see ``tree_state``.
    A null template is an empty one; empty ones of a service share a cluster.
    """
    text = F.trim(F.coalesce("normalized_template", F.lit("")))
    rows = templates.where("template_id is not null").select(F.coalesce("service_name", F.lit("")).alias("service_name"), "template_id", text.alias("normalized_template"), F.col("event_count").cast("long").alias("event_count"))
    rows = rows.withColumn("n_tokens", F.when(F.col("normalized_template") == "", 0).otherwise(F.size(F.split("normalized_template", r"[ \t\n\r\f]+"))))
    run, cols = _cluster(depth, threshold, max_children), [c.strip().split()[0] for c in _OUT.split(",")]
    key = ["service_name", "n_tokens"]
    if state is None:
        return rows.groupBy(*key).applyInPandas(lambda pdf: run(pdf)[0][cols], _OUT)
    with_state = lambda pdf, st: run(pdf, st)[0][cols] if len(pdf) else pd.DataFrame(columns=cols)
    return rows.groupBy(*key).cogroup(state.groupBy(*key)).applyInPandas(with_state, _OUT)


def tree_state(templates: DataFrame, state: DataFrame | None = None, depth: int = 4, threshold: float = 0.5, max_children: int = 100) -> DataFrame:
    """The trees after the templates, one row per (service_name, n_tokens), to go on from later."""
    text = F.trim(F.coalesce("normalized_template", F.lit("")))
    rows = templates.where("template_id is not null").select(F.coalesce("service_name", F.lit("")).alias("service_name"), "template_id", text.alias("normalized_template"), "event_count")
    rows = rows.withColumn("n_tokens", F.when(F.col("normalized_template") == "", 0).otherwise(F.size(F.split("normalized_template", r"[ \t\n\r\f]+"))))
    run = _cluster(depth, threshold, max_children)
    one = lambda pdf, st: pd.DataFrame({"service_name": [(pdf if len(pdf) else st)["service_name"].iloc[0]], "n_tokens": [int((pdf if len(pdf) else st)["n_tokens"].iloc[0])], "state": [run(pdf, st)[1].dump() if len(pdf) else st["state"].iloc[0]]})
    schema = "service_name string, n_tokens int, state string"
    if state is None:
        return rows.groupBy("service_name", "n_tokens").applyInPandas(lambda pdf: one(pdf, None), schema)
    return rows.groupBy("service_name", "n_tokens").cogroup(state.groupBy("service_name", "n_tokens")).applyInPandas(one, schema)


def changes(clusters: DataFrame) -> DataFrame:
    """The templates that move to another one: where there are none, nothing has to be rewritten."""
    return clusters.where("template_id <> canonical_template_id").select("template_id", "canonical_template_id")


def rollup(clusters: DataFrame) -> DataFrame:
    """Canonical templates: their members, events and number of members."""
    g = clusters.groupBy("service_name", "canonical_template_id")
    return g.agg(F.sum("event_count").alias("event_count"), F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list("template_id")).alias("member_template_ids"), F.max("drain_template").alias("drain_template"))
