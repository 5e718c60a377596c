"""Diagram records: cuts by DataFrames, ordering and placement by small kernels on what is left.

The kernels get what a cut has bounded (at most a few dozen boxes, or the calls within three steps
of one function); nothing here runs on a whole graph.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions import display as V
from lumengraph.functions import labels as L
from lumengraph.operators import delta, rollup
from lumengraph.operators import sequence as calls
from lumengraph.runtime import durable

MOST_MODULES, MOST_LINKS, MOST_ARTIFACTS, MOST_NODES, MOST_REGIONS, MOST_CALLERS = 36, 60, 10, 40, 1000, 10
BOX = (150, 56)
GAP = (60, 40)
#: One fill for each role.
FILLS = {"Frontend": "#0f766e", "Backend": "#1d4ed8", "Database": "#7c3aed", "Cloud": "#0369a1", "Security": "#b91c1c", "Messagebus": "#b45309", "External": "#475569"}


# Sequence


def root_function(nodes: DataFrame, edges: DataFrame, root: str):  # noqa: ANN201
    """The function or method meant by `root`: in main.rs first, then the one with most calls, then the last."""
    named = (F.col("name") == root) | (F.col("id") == root) | F.col("id").endswith(f":{root}")
    found = nodes.where(F.col("kind").isin("Function", "Method") & named)
    calls = edges.where("relation = 'Calls'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    rows = found.join(calls, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rows.agg(F.max_by(F.struct("id", "name"), F.struct(F.col("path").endswith("main.rs"), F.col("n"), F.col("ord"))).alias("x")).first()
    return best.x


def sequence(nodes: DataFrame, edges: DataFrame, root: str, locale: str = "en") -> dict:
    """A call sequence: participants in the order in which they appear, and messages."""
    start = root_function(nodes, edges, root)
    first = start.id if start else root
    known = nodes.select("id", "name", "path", "search_body") if "search_body" in nodes.columns else nodes.select("id", "name", "path", F.lit("").alias("search_body"))
    roots = nodes.sparkSession.createDataFrame([(first,)], "id string")
    said = calls.messages(edges.where("relation = 'Calls'"), roots, known)
    told = known.select(F.col("id").alias("target"), "name", F.contains("search_body", F.lit("async ")).alias("later"), L.role_for(F.col("name"), F.col("path")).alias("role"))
    rows = said.join(told, "target").orderBy("place").collect()  # at most MESSAGES
    info = {r.target: r for r in rows}
    order = dict.fromkeys([first, *(r.target for r in rows)])
    word = L.pick(locale, L.RELATION_LABELS["Calls"])
    return {
        "participants": [{"id": i, "label": info[i].name if i in info and i != first else (start.name if start else root), "role": "Frontend" if i == first else info[i].role} for i in order],
        "messages": [{"order": r.place, "from": r.source, "to": r.target, "action": f"{word} {r.name}()", "is_async": r.later} for r in rows],
    }


# Layers


def layers(n: int, edges: list[tuple[int, int]], by_place: bool = False) -> list[int]:
    """Longest-path layers; an edge that closes a cycle on the way down is dropped.

    The way down starts at the nodes that fewest edges enter, or with `by_place` in their own order.
    """
    out: dict[int, dict[int, None]] = defaultdict(dict)
    for a, b in edges:
        if a != b:
            out[a].setdefault(b)
    into = [0] * n
    for targets in out.values():
        for b in targets:
            into[b] += 1
    state, kept, finished = [0] * n, defaultdict(list), []
    for root in range(n) if by_place else sorted(range(n), key=lambda v: (into[v], v)):
        if state[root]:
            continue
        state[root] = 1
        path = [(root, iter(out[root]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if state[w] != 1:
                    kept[v].append(w)
                if not state[w]:
                    state[w] = 1
                    path.append((w, iter(out[w])))
                    break
            else:
                state[v] = 2
                finished.append(v)
                path.pop()
    level = [0] * n
    for v in reversed(finished):  # every kept edge leads to a node that finished earlier
        for w in kept[v]:
            level[w] = max(level[w], level[v] + 1)
    return level


def ordered_columns(level: list[int], edges: list[tuple[int, int]], sweeps: int = 4) -> list[list[int]]:
    """Nodes by layer, each layer sorted by the mean place of its neighbours, down and up in turn."""
    columns = [[v for v in range(len(level)) if level[v] == k] for k in range(max(level, default=-1) + 1)]
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for sweep in range(sweeps):
        place = {v: k for own in columns for k, v in enumerate(own)}
        for own in columns if sweep % 2 == 0 else columns[::-1]:
            middle = {v: sum(place[w] for w in near[v]) / len(near[v]) if near[v] else place[v] for v in own}
            own.sort(key=lambda v: (middle[v], v))
            place |= {v: k for k, v in enumerate(own)}
    return columns


def extent(boxes: DataFrame, by: str | None = None) -> DataFrame:
    """Bounding boxes (x, y, width, height) of `boxes(x, y, width, height)`, of all or per group."""
    ends = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height")]
    return boxes.groupBy(by).agg(*ends) if by else boxes.agg(*ends)


def smallest_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """`points(id, x, y)` with the smallest of `regions(id, x, y, width, height)` that holds each, or null.

    A picture has a few dozen regions; they are counted and then held as a constant.
    """
    held = regions.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]).limit(MOST_REGIONS + 1).collect()
    if len(held) > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions in one picture")
    if not held:
        return points.select("id", F.lit(None).cast("string").alias("region"))
    boxes = F.array(*[F.struct(F.lit(r.width * r.height).alias("area"), F.lit(r.id).alias("id"), F.lit(r.x).alias("x"), F.lit(r.y).alias("y"), F.lit(r.x + r.width).alias("right"), F.lit(r.y + r.height).alias("bottom")) for r in held])
    holds = F.filter(boxes, lambda b: (F.col("x") >= b["x"]) & (F.col("x") <= b["right"]) & (F.col("y") >= b["y"]) & (F.col("y") <= b["bottom"]))
    return points.select("id", F.array_min(holds)["id"].alias("region"))


# Records


def _placed(boxes: list[dict], links: list[tuple[int, int]]) -> None:
    """Puts boxes into columns by layer, in an order that keeps neighbours near."""
    for column, own in enumerate(ordered_columns(layers(len(boxes), links), links)):
        for row, k in enumerate(own):
            boxes[k] |= {"x": column * (BOX[0] + GAP[0]), "y": row * (BOX[1] + GAP[1]), "width": BOX[0], "height": BOX[1]}


def _regions(boxes: list[dict], words: dict[str, str]) -> list[dict]:
    """A frame around the boxes of each region."""
    out = []
    for name in dict.fromkeys(b["region"] for b in boxes):
        own = [b for b in boxes if b["region"] == name]
        x, y = min(b["x"] for b in own), min(b["y"] for b in own)
        out.append({"id": name, "label": name, "sublabel": words.get(name), "x": x - 10, "y": y - 10, "width": max(b["x"] for b in own) + BOX[0] + 20 - x, "height": max(b["y"] for b in own) + BOX[1] + 20 - y})
    return out


def package_level(boxes: DataFrame, linked: DataFrame, title: str = "", locale: str = "en") -> dict:
    """Packages and their dependencies, as `packages.summary` gives them, cut to what a picture can show."""
    from lumengraph.operators import packages, tours

    shown = packages.top_boxes(boxes, linked)
    rows = [r.asDict() for r in boxes.join(shown.select("key"), "key").orderBy("ord").collect()]  # at most 48
    at = {r["key"]: k for k, r in enumerate(rows)}
    ends = shown.select("key")
    inside = linked.join(ends.withColumnRenamed("key", "from"), "from", "left_semi").join(ends.withColumnRenamed("key", "to"), "to", "left_semi")
    links = sorted((r.asDict() for r in inside.collect()), key=lambda x: (at[x["from"]], at[x["to"]]))
    components = []
    for r in rows:
        kind = L.pick(locale, L.BOTH if r["lib"] and r["bin"] else L.BINARY if r["bin"] else L.LIBRARY)
        told = L.pick(locale, L.FAR) if r["external"] else L.pick(locale, L.LINES) % (kind, r["lines"])
        components.append({"id": r["id"], "label": r["label"], "region": r["box"], "role": r["role"], "sublabel": told})
    _placed(components, [(at[x["from"]], at[x["to"]]) for x in links])
    connections = []
    for x in links:
        style = "dashed" if x["optional"] else "dotted" if rows[at[x["to"]]]["external"] else L.ANIMATED if x["uses"] >= L.STRONG_USES else ""
        label = L.pick(locale, L.USES) % x["uses"] if x["uses"] else L.pick(locale, L.DEPENDS)
        connections.append({"from": rows[at[x["from"]]]["id"], "to": rows[at[x["to"]]]["id"], "label": label, "line_style": style, "weight": x["uses"]})
    words = {name: L.pick(locale, L.FAR_OF if all(r["external"] for r in rows if r["box"] == name) else L.WORKSPACE_OF) % sum(r["box"] == name for r in rows) for name in {r["box"] for r in rows}}
    subtitle = L.pick(locale, L.PACKAGES) % (len(rows), boxes.count(), len(connections))
    return {"title": title, "subtitle": subtitle, "components": components, "connections": connections, "regions": _regions(components, words), "story": tours.package_tour(rows, links, locale)}


def architecture(nodes: DataFrame, edges: DataFrame, title: str = "", locale: str = "en", scope: tuple[str, str] | None = None) -> dict:
    """Modules and their links, cut to what a picture can show, with roles, layers and places."""
    placed = rollup.modules_of(nodes, scope)
    mods, deps = rollup.modules(placed), rollup.dependencies(placed, edges)
    shown = rollup.top_modules(mods, deps, MOST_MODULES)
    rows = mods.join(shown, "key").select("key", "region", "module", "files", "symbols", L.role_for(F.col("module"), F.col("region")).alias("role"), L.counts_label(F.col("files"), F.col("symbols"), locale).alias("label")).orderBy("key").collect()
    links = rollup.top_dependencies(deps, shown, MOST_LINKS).select("from", "to", "count", "dominant", F.concat(L.relation_label(F.col("dominant"), locale), F.format_string(" ×%d", "count")).alias("label")).orderBy("from", "to").collect()
    from lumengraph.operators import tours

    at = {r.key: k for k, r in enumerate(rows)}
    boxes = [{"id": r.key, "label": r.module, "region": r.region, "role": r.role, "sublabel": r.label} for r in rows]
    _placed(boxes, [(at[x["from"]], at[x["to"]]) for x in links])
    connections = [{"from": x["from"], "to": x["to"], "label": x.label, "line_style": "", "weight": x["count"]} for x in links]
    subtitle = V.escape(L.pick(locale, L.SUBTITLE) % (len(rows), mods.count(), len(links)))
    return {"title": title, "subtitle": subtitle, "components": boxes, "connections": connections, "regions": _regions(boxes, {}), "story": tours.module_tour(boxes, connections, locale)}


def dataflow(edges: DataFrame, most: int = MOST_ARTIFACTS, packages: DataFrame | None = None) -> dict:
    """The most used data files, their first users and the pipelines between them.

    packages: (id, package) of functions; with it, where data enters the program: for each user shown
    its first caller from another package that isn't shown yet, `MOST_CALLERS` and `MOST_NODES` at most.
    """
    # Edges are met once; all that follows comes from the pairs of files and users, or from those of the few files shown.
    pairs = durable(rollup.artifact_pairs(edges), "pairs")
    top = F.broadcast(durable(rollup.ranked_artifacts(pairs, most).select("artifact"), "top"))  # at most `most` rows
    pairs = pairs.join(top, "artifact", "left_semi")
    relation = F.explode(F.filter(F.array(F.when(F.col("reads"), "Reads"), F.when(F.col("writes"), "Writes")), lambda x: x.isNotNull())).alias("relation")
    rows = rollup.first_users(pairs).join(pairs.select("artifact", "user", relation), ["artifact", "user"]).orderBy("artifact", "place", "relation").collect()
    names = sorted({r.artifact for r in rows} | {r.user for r in rows})
    pipes = [{"from": r.user, "to": r.artifact, "kind": "write"} if r.relation == "Writes" else {"from": r.artifact, "to": r.user, "kind": "read"} for r in rows]
    entries = entry_calls(edges, [r.user for r in rows], packages, MOST_NODES - len(names)) if packages is not None and rows else []
    names += [source for source, _ in entries]
    pipes += [{"from": source, "to": target, "kind": "call"} for source, target in entries]
    return {"nodes": [{"id": n} for n in names], "pipelines": pipes, "hidden": {r.artifact: r.hidden for r in rows}}


def entry_calls(edges: DataFrame, users: list[str], packages: DataFrame, room: int, most: int = MOST_CALLERS) -> list[tuple[str, str]]:
    """(caller, user): in the order of calls, one caller from another package for each user, and one user for each caller.

    A user's first `most` + 1 callers suffice, as no more than `most` can be taken already.
    """
    shown = sorted(set(users))
    own = packages.select(F.col("id").alias("source"), F.col("package").alias("from"))
    to = packages.where(F.col("id").isin(shown)).select(F.col("id").alias("target"), F.col("package").alias("to"))
    rows = edges.where("relation = 'Calls'").where(F.col("target").isin(shown) & ~F.col("source").isin(shown)).join(own, "source", "left").join(to, "target", "left")
    first = rows.where(~F.col("from").eqNullSafe(F.col("to"))).groupBy("source", "target").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("ord", "source"))
    found = first.withColumn("rank", rank).where(F.col("rank") <= most + 1).orderBy("ord", "target").select("source", "target").collect()
    taken: dict[str, str] = {}
    served: set[str] = set()
    for r in found:
        if len(taken) < min(most, room) and r.source not in taken and r.target not in served:
            taken[r.source] = r.target
            served.add(r.target)
    return list(taken.items())


def file_links(nodes: DataFrame, edges: DataFrame, locale: str = "en", most: int = MOST_NODES) -> dict:
    """The record for a tree without data files or packages: the files with most imports and the imports among them."""
    imports = edges.where("relation = 'Imports'")
    degree = rollup.weighted_degree(imports, "source", "target")
    top = degree.orderBy(F.desc("degree"), "key").limit(most)
    rows = nodes.join(top, F.col("id") == F.col("key")).select("id", "name", L.role_for(F.col("name"), F.lit("")).alias("role"), "degree").orderBy(F.desc("degree"), "id").collect()
    ends = top.select("key")
    kept = imports.join(ends.withColumnRenamed("key", "source"), "source", "left_semi").join(ends.withColumnRenamed("key", "target"), "target", "left_semi")
    pipes = [{"from": r.source, "to": r.target, "kind": L.pick(locale, L.RELATION_LABELS["Imports"])} for r in kept.select("source", "target").orderBy("source", "target").collect()]  # among 40 files
    return {"subtitle": L.pick(locale, L.FILE_LINKS), "nodes": [{"id": r.id, "label": r.name, "role": r.role} for r in rows], "pipelines": pipes}


def difference(before: dict, after: dict, spark) -> dict:  # noqa: ANN001
    """Components and connections of two architecture records with their status; places do not count."""
    comp = lambda d: spark.createDataFrame([(c["id"], c["label"], c["role"], c.get("sublabel")) for c in d["components"]], "id string, label string, role string, sublabel string")
    link = lambda d: spark.createDataFrame([(c["from"], c["to"]) for c in d["connections"]], "`from` string, `to` string")
    components = delta.components(comp(before), comp(after), ["label", "role", "sublabel"]).orderBy("id").collect()
    connections = delta.connections(link(before), link(after)).orderBy("from", "to").collect()
    return {"components": [r.asDict() for r in components], "connections": [r.asDict() for r in connections]}


def to_json(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False, sort_keys=True)


# Pictures


def svg(record: dict) -> str:
    """An architecture record as SVG: boxes by role, straight links with labels, a legend."""
    w = max((c["x"] for c in record["components"]), default=0) + BOX[0] + 40
    h = max((c["y"] for c in record["components"]), default=0) + BOX[1] + 100
    at = {c["id"]: c for c in record["components"]}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" font-family="monospace" font-size="12">', f"<title>{V.escape(record['title'])}</title>"]
    for link in record["connections"]:
        a, b = at[link["from"]], at[link["to"]]
        x1, y1, x2, y2 = (V.plain_number(v) for v in (a["x"] + 20 + BOX[0] / 2, a["y"] + 40 + BOX[1] / 2, b["x"] + 20 + BOX[0] / 2, b["y"] + 40 + BOX[1] / 2))
        wide, dashes = L.EDGE_STROKES[L.EDGE_KINDS.get((link.get("line_style") or "").lower(), "default")]
        dash = f' stroke-dasharray="{" ".join(map(str, dashes))}"' if dashes else ""
        out.append(f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="#94a3b8" stroke-width="{wide}"{dash}><title>{V.escape(link["label"])}</title></line>')
    for c in record["components"]:
        text, font, _ = V.fit(c["label"], BOX[0] - 16, 12, 8)
        out.append(f'<g transform="translate({c["x"] + 20},{c["y"] + 40})"><rect width="{BOX[0]}" height="{BOX[1]}" rx="6" fill="{FILLS.get(c["role"], "#475569")}"/><text x="8" y="24" fill="#fff" font-size="{V.plain_number(font)}">{V.escape(text)}</text><text x="8" y="42" fill="#e2e8f0" font-size="9">{V.escape(V.truncate(c.get("sublabel") or "", 28))}</text></g>')
    roles = [r for r in L.ROLE_ORDER if any(c["role"] == r for c in record["components"])]
    for k, role in enumerate(roles):
        n = sum(c["role"] == role for c in record["components"])
        out.append(f'<text x="{20 + 120 * k}" y="{h - 12}" fill="{FILLS[role]}">{role} {n}</text>')
    return "\n".join([*out, "</svg>"])


def sequence_svg(record: dict) -> str:
    """A call sequence as SVG: a life line per participant, an arrow per message."""
    column = {p["id"]: 20 + 150 * k for k, p in enumerate(record["participants"])}
    h = 80 + 36 * len(record["messages"])
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {150 * len(column) + 40} {h}" font-family="monospace" font-size="11">']
    for p in record["participants"]:
        x = column[p["id"]]
        out.append(f'<text x="{x}" y="20">{V.escape(V.truncate(p["label"], 20))}</text><line x1="{x + 40}" y1="28" x2="{x + 40}" y2="{h}" stroke="#cbd5e1"/>')
    for m in record["messages"]:
        y = 24 + 36 * m["order"]
        dash = ' stroke-dasharray="4 3"' if m["is_async"] else ""
        out.append(f'<line x1="{column[m["from"]] + 40}" y1="{y}" x2="{column[m["to"]] + 40}" y2="{y}" stroke="#1d4ed8"{dash}/><text x="{min(column[m["from"]], column[m["to"]]) + 46}" y="{y - 4}">{V.escape(m["action"])}</text>')
    return "\n".join([*out, "</svg>"])


def html(picture: str, title: str) -> str:
    """A picture in a page without scripts."""
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{V.escape(title)}</title></head><body>{picture}</body></html>'


def write_picture(picture: str, path: str, title: str = "") -> tuple[str, int]:
    """Writes SVG as it is, anything else as a page; returns the path and its bytes."""
    raw = (picture if path.endswith(".svg") else html(picture, title)).encode()
    with open(path, "wb") as f:
        f.write(raw)
    return path, len(raw)
