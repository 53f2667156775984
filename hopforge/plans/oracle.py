"""DuckDB SQL of the query catalogue, put together from named common table expressions."""

from __future__ import annotations

import re

from hopforge.operators.layers import fixed_weights

CTE: dict[str, str] = {
    "edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'",
    "mid": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey WHERE a.l_returnflag = 'R'",
    "alls": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey",
    "nodes": "SELECT p_partkey AS node FROM part",
    "seeds": "SELECT p_partkey AS node, (p_partkey // 20) % 4 AS part FROM part WHERE p_partkey % 20 = 0",
    "feats": "SELECT p_partkey AS node, embedding AS feat, label::BIGINT AS label FROM part JOIN embeddings ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id",
    # Reachability, one expression a hop.
    "m0": "SELECT part, node FROM seeds",
    "m1": "SELECT DISTINCT part, src AS node FROM m0 JOIN edges ON dst = node EXCEPT SELECT * FROM m0",
    "m2": "SELECT DISTINCT part, src AS node FROM m1 JOIN edges ON dst = node EXCEPT (SELECT * FROM m0 UNION ALL SELECT * FROM m1)",
    "m3": "SELECT DISTINCT part, src AS node FROM m2 JOIN edges ON dst = node EXCEPT (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)",
    "members": "SELECT *, 0::BIGINT AS hop FROM m0 UNION ALL SELECT *, 1 FROM m1 UNION ALL SELECT *, 2 FROM m2 UNION ALL SELECT *, 3 FROM m3",
    "interior": "SELECT part, node FROM members WHERE hop < 3",
    "kept": "SELECT part, src, dst FROM edges JOIN interior ON dst = node UNION ALL SELECT part, node, node FROM seeds",
    "ids": "SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS lid FROM members",
    "local_e": "SELECT k.part, a.lid AS src, b.lid AS dst FROM kept k JOIN ids a ON a.part = k.part AND a.node = k.src JOIN ids b ON b.part = k.part AND b.node = k.dst",
    # Values.
    "ind": "SELECT dst AS node, count(*) AS n FROM edges GROUP BY dst",
    "v0": "SELECT node, CASE WHEN node % 20 = 0 THEN 100000 ELSE 0 END::BIGINT AS value FROM nodes",
    **{f"v{i}": f"SELECT v.node, (v.value + coalesce(g.gain, 0))::BIGINT AS value FROM v{i - 1} v LEFT JOIN (SELECT src AS node, sum(u.value // ind.n) AS gain FROM edges JOIN v{i - 1} u ON u.node = dst JOIN ind ON ind.node = dst GROUP BY src) g USING (node)" for i in (1, 2, 3)},
    "ranked": "SELECT part, node, value, row_number() OVER (PARTITION BY part ORDER BY value DESC, node) AS rank FROM members JOIN v3 USING (node)",
    # Labels of seeds.
    "near": "SELECT src AS node, dst AS other FROM {graph} WHERE src % 20 = 0 AND dst % 20 = 0 UNION ALL SELECT dst, src FROM {graph} WHERE src % 20 = 0 AND dst % 20 = 0",
    "labels_": "SELECT node, least(node, coalesce(o, node)) AS label FROM seeds LEFT JOIN (SELECT node, min(other) AS o FROM near GROUP BY node) USING (node)",
    # Parts against parts.
    "sizes": "SELECT part, count(*) AS n FROM members GROUP BY part",
    "both_": "SELECT a.part AS i, b.part AS j, count(*) AS n FROM members a JOIN members b USING (node) GROUP BY a.part, b.part",
    "costs": "SELECT a.part AS i, b.part AS j, b.n - coalesce(o.n, 0) AS cost FROM sizes a CROSS JOIN sizes b LEFT JOIN both_ o ON o.i = a.part AND o.j = b.part",
    "paths": "SELECT x.cost + y.cost + z.cost AS cost, x.i AS a, x.j AS b, y.j AS c, z.j AS d FROM costs x JOIN costs y ON y.i = x.j JOIN costs z ON z.i = y.j WHERE x.i NOT IN (x.j, y.j, z.j) AND x.j NOT IN (y.j, z.j) AND y.j <> z.j",
    "best": "SELECT * FROM paths ORDER BY cost, a, b, c, d LIMIT 1",
    "turns": "SELECT unnest([0, 1, 2, 3])::BIGINT AS seq, unnest([a, b, c, d]) AS part, cost::BIGINT AS path_cost FROM best",
    "steps": "SELECT x.part AS from_part, y.part AS to_part FROM turns x JOIN turns y ON y.seq = (x.seq + 1) % 4",
    "same_": "SELECT from_part, to_part, p.node, p.lid AS prev_pos, q.lid AS next_pos FROM steps JOIN ids p ON p.part = from_part JOIN ids q ON q.part = to_part AND q.node = p.node",
    "added_": "SELECT from_part, to_part, q.node, q.lid AS next_pos FROM steps JOIN ids q ON q.part = to_part WHERE NOT EXISTS (SELECT 1 FROM ids p WHERE p.part = from_part AND p.node = q.node)",
    "freed_": "SELECT from_part, to_part, p.lid AS prev_pos FROM steps JOIN ids p ON p.part = from_part WHERE NOT EXISTS (SELECT 1 FROM ids q WHERE q.part = to_part AND q.node = p.node)",
    "pads": "SELECT from_part, to_part, unnest(range(a.n, (SELECT max(n) FROM sizes))) AS prev_pos FROM steps JOIN sizes a ON a.part = from_part",
    "padn": "SELECT from_part, to_part, unnest(range(a.n, (SELECT max(n) FROM sizes))) AS next_pos FROM steps JOIN sizes a ON a.part = to_part",
    "pairs": "SELECT o.from_part, o.to_part, o.k, prev_pos, next_pos FROM (SELECT *, row_number() OVER (PARTITION BY from_part, to_part ORDER BY prev_pos) - 1 AS k FROM (SELECT * FROM freed_ UNION ALL SELECT * FROM pads)) o JOIN (SELECT *, row_number() OVER (PARTITION BY from_part, to_part ORDER BY next_pos) - 1 AS k FROM (SELECT from_part, to_part, next_pos FROM added_ UNION ALL SELECT * FROM padn)) n ON n.from_part = o.from_part AND n.to_part = o.to_part AND n.k = o.k",
    # Trimming and tiers.
    "cutn": "SELECT part, node, rank <= first AS top, row_number() OVER (PARTITION BY part, rank <= first ORDER BY md5('42|' || part || '|' || node), node) AS lot, floor((n - first) * 0.8) AS drops FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n, floor(count(*) OVER (PARTITION BY part) * 0.6) AS first FROM ranked)",
    "trimmed": "SELECT part, node, top OR lot > drops AS kept FROM cutn",
    "slots": "SELECT part, node, CASE WHEN kept THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY part, kept ORDER BY node) AS slot FROM trimmed",
    "swaps": "SELECT u.part, u.node AS un, u.slot AS us, v.node AS dn, v.slot AS ds FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY node) AS i FROM slots WHERE node % 3 = 0 AND slot < 0) u JOIN (SELECT *, row_number() OVER (PARTITION BY part ORDER BY node) AS i FROM slots WHERE node % 3 <> 0 AND slot > 0) v ON u.part = v.part AND u.i = v.i",
    # Sampling.
    "batches": "SELECT part * 1048576 + place // 16 AS batch, part, place % 16 AS pos, node FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5('42|0|' || node), node) - 1 AS place FROM seeds)",
    "f0": "SELECT batch, pos AS occ, node FROM batches",
    **{f"s{h}": f"SELECT * FROM (SELECT batch, {h}::BIGINT AS hop, occ, row_number() OVER (PARTITION BY batch, occ ORDER BY md5('42|' || batch || '|{h}|' || occ || '|' || src), src) AS k, src, dst FROM f{h - 1} JOIN mid ON dst = node) WHERE k <= {n}" for h, n in ((1, 3), (2, 3), (3, 2))},
    **{f"f{h}": f"SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY occ, k) - 1 AS occ, src AS node FROM s{h}" for h in (1, 2)},
    "drawn": "SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3",
    "firsts": "SELECT batch, node, min((hop, occ, k)) AS place FROM (SELECT batch, node, 0::BIGINT AS hop, pos AS occ, 0::BIGINT AS k FROM batches UNION ALL SELECT batch, src, hop, occ, k FROM drawn) GROUP BY batch, node",
    "mapping": "SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY place) - 1 AS lid, node FROM firsts",
    # Layers; a vector is a row per entry.
    "x0": "SELECT node, unnest(range(64)) AS dim, unnest(feat)::DOUBLE AS val FROM feats",
    "nb0": "SELECT dst AS node, dim, avg(val) AS val FROM mid JOIN x0 ON x0.node = src GROUP BY dst, dim",
    "h1": "SELECT node, i, greatest(0, sum(v)) AS val FROM (SELECT node, i, val * w AS v FROM x0 JOIN ws1 ON dim = j UNION ALL SELECT node, i, val * w FROM nb0 JOIN wn1 ON dim = j) GROUP BY node, i",
    "nb1": "SELECT dst AS node, i AS dim, avg(val) AS val FROM mid JOIN h1 ON h1.node = src GROUP BY dst, i",
    "scores": "SELECT node, i AS dim, sum(v) AS val FROM (SELECT node, ws2.i, val * w AS v FROM h1 JOIN ws2 ON h1.i = j UNION ALL SELECT node, wn2.i, val * w FROM nb1 JOIN wn2 ON dim = j) GROUP BY node, i",
    "preds": "SELECT node, min(dim) AS pred FROM (SELECT *, max(val) OVER (PARTITION BY node) AS top FROM scores) WHERE val = top GROUP BY node",
    "split_": "SELECT node, CASE WHEN node % 10 < 6 THEN 'train' WHEN node % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM nodes",
    "outdeg": "SELECT src AS node, count(*) AS n FROM mid GROUP BY src",
    "indeg": "SELECT dst AS node, count(*) AS n FROM mid GROUP BY dst",
    # Link prediction.
    "lp": "SELECT CASE WHEN r <= floor(k * 0.3) THEN 'train' WHEN r <= floor(k * 0.3) + floor(k * 0.6) THEN 'test' ELSE 'valid' END AS split, src, dst FROM (SELECT *, floor(count(*) OVER () * 0.2) AS k, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst), src, dst) AS r FROM mid) WHERE r <= k",
}


def _weights(name: str, rows: int, columns: int, salt: int = 0) -> None:
    listed = ", ".join(f"({i}::BIGINT, {j}::BIGINT, {w}::DOUBLE)" for i, row in enumerate(fixed_weights(rows, columns, salt)) for j, w in enumerate(row))
    CTE[name] = f"SELECT * FROM (VALUES {listed}) t(i, j, w)"


for _name, *_shape in (("ws0", 4, 64), ("wn0", 4, 64, 5), ("ws1", 8, 64), ("wn1", 8, 64, 5), ("ws2", 10, 8, 1), ("wn2", 10, 8, 6)):
    _weights(_name, *_shape)
for _h, _salt in (*((str(i), salt) for i, salt in ((0, 0), (1, 3))), *((f"h{i}", i) for i in range(8))):
    _weights(f"wg{_h}", 4, 64, _salt)
    _listed = ", ".join(f"({j}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)" for j, (a, b) in enumerate(zip(fixed_weights(1, 4, _salt + 1)[0], fixed_weights(1, 4, _salt + 2)[0], strict=True)))
    CTE[f"att{_h}"] = f"SELECT * FROM (VALUES {_listed}) t(j, a, b)"
    CTE[f"z{_h}"] = f"SELECT node, i AS dim, sum(val * w) AS val FROM x0 JOIN wg{_h} ON dim = j GROUP BY node, i"
    CTE[f"lr{_h}"] = f"SELECT node, sum(val * a) AS l, sum(val * b) AS r FROM z{_h} JOIN att{_h} ON dim = j GROUP BY node"
    CTE[f"e{_h}"] = f"SELECT src, dst, CASE WHEN p.l + q.r > 0 THEN p.l + q.r ELSE 0.2 * (p.l + q.r) END AS e FROM mid JOIN lr{_h} p ON p.node = src JOIN lr{_h} q ON q.node = dst"
    CTE[f"w{_h}"] = f"SELECT src, dst, exp(e - max(e) OVER (PARTITION BY dst)) AS w FROM e{_h}"
    CTE[f"g{_h}"] = f"SELECT dst AS node, dim, sum(val * w) / sum(w) AS val FROM w{_h} JOIN z{_h} ON z{_h}.node = src GROUP BY dst, dim"


def _gcn(name: str, x: str, weights: str, shape: str) -> None:
    CTE[name] = f"SELECT node, dim, {shape} AS val FROM (SELECT n.node, w.i AS dim, sum(coalesce(s.val, 0) * w.w) AS v FROM nodes n CROSS JOIN {weights} w LEFT JOIN (SELECT dst AS node, dim, sum(val / sqrt(o.n)) / sqrt(max(g.n)) AS val FROM mid JOIN {x} y ON y.node = src JOIN outdeg o ON o.node = src JOIN indeg g ON g.node = dst GROUP BY dst, dim) s ON s.node = n.node AND s.dim = w.j GROUP BY n.node, w.i)"


_weights("wc1", 8, 64)
_weights("wc2", 4, 8, 1)
_gcn("c1", "x0", "wc1", "greatest(0, v)")
_gcn("c2", "c1", "wc2", "v")
CTE["a1"] = "SELECT n.node, d.dim, coalesce(CASE WHEN d.dim < 4 THEN a.val ELSE b.val END, 0) AS v FROM nodes n CROSS JOIN (SELECT unnest(range(8)) AS dim) d LEFT JOIN g0 a ON a.node = n.node AND a.dim = d.dim LEFT JOIN g1 b ON b.node = n.node AND b.dim = d.dim - 4"
CTE["x1"] = "SELECT node, dim, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS val FROM a1"
_weights("wg2", 4, 8, 2)
CTE["att2"] = "SELECT * FROM (VALUES " + ", ".join(f"({j}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)" for j, (a, b) in enumerate(zip(fixed_weights(1, 4, 6)[0], fixed_weights(1, 4, 7)[0], strict=True))) + ") t(j, a, b)"
CTE["z2"] = "SELECT node, i AS dim, sum(val * w) AS val FROM x1 JOIN wg2 ON dim = j GROUP BY node, i"
for _n in "lr", "e", "w", "g":
    CTE[f"{_n}2"] = re.sub(r"\b(z|att|lr|e|w)0\b", r"\g<1>2", CTE[f"{_n}0"])
# The residual block: a linear layer, a mean layer, batch norm, and both outputs side by side.
_weights("wr0", 4, 64)
_weights("wr1", 4, 4, 1)
_weights("wr2", 4, 4, 2)
_weights("wr3", 3, 8, 3)
CTE["r0"] = "SELECT node, i AS dim, sum(val * w) AS val FROM x0 JOIN wr0 ON dim = j GROUP BY node, i"
CTE["nr0"] = "SELECT dst AS node, dim, avg(val) AS val FROM mid JOIN r0 ON r0.node = src GROUP BY dst, dim"
CTE["r1"] = "SELECT node, i AS dim, sum(v) AS val FROM (SELECT node, i, val * w AS v FROM r0 JOIN wr1 ON dim = j UNION ALL SELECT node, i, val * w FROM nr0 JOIN wr2 ON dim = j) GROUP BY node, i"
CTE["bn"] = "SELECT node, dim, (val - avg(val) OVER (PARTITION BY dim)) / sqrt(var_pop(val) OVER (PARTITION BY dim) + 0.00001) AS val FROM r1"
CTE["r2"] = "SELECT node, dim, greatest(0, bn.val) + r0.val AS val FROM bn JOIN r0 USING (node, dim)"
CTE["r3"] = "SELECT node, dim, val FROM r0 UNION ALL SELECT node, dim + 4, val FROM r2"


# Evaluation over sampled neighbours.
CTE["evals"] = "SELECT place // 16 AS batch, place % 16 AS occ, node FROM (SELECT node, row_number() OVER (ORDER BY md5('42|0|' || node), node) - 1 AS place FROM split_ WHERE split <> 'train')"
_DRAWN = "SELECT * FROM (SELECT batch, {h}::BIGINT AS hop, occ, row_number() OVER (PARTITION BY batch, occ ORDER BY md5('42|' || batch || '|{h}|' || occ || '|' || src), src) AS k, src, dst FROM {f} JOIN mid ON dst = node) WHERE k <= 3"
CTE["ev1"] = _DRAWN.format(h=1, f="evals")
CTE["evf"] = "SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY occ, k) - 1 AS occ, src AS node FROM ev1"
CTE["ev2"] = _DRAWN.format(h=2, f="evf")
CTE["evx"] = "SELECT batch, node, dim, val FROM (SELECT batch, node FROM evals UNION SELECT batch, src FROM ev1 UNION SELECT batch, src FROM ev2) JOIN x0 USING (node)"
CTE["evm"] = "SELECT e.batch, dst AS node, dim, avg(val) AS val FROM (SELECT batch, src, dst FROM ev1 UNION ALL SELECT batch, src, dst FROM ev2) e JOIN evx x ON x.batch = e.batch AND x.node = src GROUP BY e.batch, dst, dim"
CTE["evh"] = "SELECT batch, node, i AS dim, greatest(0, sum(v)) AS val FROM (SELECT batch, node, i, val * w AS v FROM evx JOIN ws1 ON dim = j UNION ALL SELECT batch, node, i, val * w FROM evm JOIN wn1 ON dim = j) GROUP BY batch, node, i"
CTE["evn"] = "SELECT e.batch, dst AS node, dim, avg(val) AS val FROM ev1 e JOIN evh x ON x.batch = e.batch AND x.node = src GROUP BY e.batch, dst, dim"
CTE["evs"] = "SELECT s.node, i AS dim, sum(v) AS val FROM (SELECT batch, node, i, val * w AS v FROM evh JOIN ws2 ON dim = j UNION ALL SELECT batch, node, i, val * w FROM evn JOIN wn2 ON dim = j) s JOIN evals USING (batch, node) GROUP BY s.node, i"
CTE["evp"] = "SELECT node, min(dim) AS pred FROM (SELECT *, max(round(val, 9)) OVER (PARTITION BY node) AS top FROM evs) WHERE round(val, 9) = top GROUP BY node"
# Slot maps along the visiting order.
CTE["moves"] = "SELECT seq, x.* FROM (SELECT from_part, to_part, prev_pos, next_pos FROM same_ UNION ALL SELECT from_part, to_part, prev_pos, next_pos FROM pairs) x JOIN turns ON part = from_part"
CTE["lap0"] = "SELECT from_part, to_part, next_pos AS lid, prev_pos AS slot FROM moves WHERE seq = 0"
for _h in (1, 2, 3):
    CTE[f"lap{_h}"] = f"SELECT m.from_part, m.to_part, next_pos AS lid, y.slot FROM moves m JOIN lap{_h - 1} y ON y.lid = prev_pos WHERE seq = {_h}"
# Cheapest and dearest part.
CTE["cheap"] = "SELECT part FROM sizes ORDER BY n, part LIMIT 1"
CTE["dear"] = "SELECT part FROM sizes WHERE part <> (SELECT part FROM cheap) ORDER BY n DESC, part LIMIT 1"


def sql(final: str, **names: str) -> str:
    """The statement with all expressions it needs before it, each worked out once."""
    needed: list[str] = []
    texts = {n: t.format(**names) if names and "{graph}" in t else t for n, t in CTE.items()}

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_]+[0-9]?", text)):
            if word in texts and word not in needed and re.search(rf"(FROM|JOIN) {word}\b", text):
                need(texts[word])
                if word not in needed:
                    needed.append(word)

    need(final)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({texts[n]})" for n in needed) + f" {final}" if needed else final


_ENTRIES = "SELECT {keys}, dim, round(val, 6) + 0.0 AS val FROM ({rows})"
_FEAT = "unnest(range(64)) AS dim, round(unnest(feat)::DOUBLE, 6) AS val"

ORACLE: dict[str, str] = {
    "edges_copurchase": sql("SELECT src, dst FROM edges"),
    "edges_full": sql("SELECT dst AS node, count(*) AS indeg FROM alls GROUP BY dst"),
    "degree_in_out": sql("SELECT node, coalesce(i.n, 0) AS indeg, coalesce(o.n, 0) AS outdeg FROM nodes LEFT JOIN indeg i USING (node) LEFT JOIN outdeg o USING (node)"),
    "avg_degree": sql("SELECT n.c AS n_nodes, e.c AS n_edges, round(e.c / n.c, 6) AS avg_degree FROM (SELECT count(*) AS c FROM nodes) n, (SELECT count(*) AS c FROM mid) e"),
    "seed_label_propagation": sql("SELECT node, label FROM labels_", graph="alls"),
    "seed_label_histogram": sql("SELECT label, count(*) AS n FROM labels_ GROUP BY label", graph="mid"),
    "seed_partition_assign": sql("SELECT node, label, part FROM labels_ JOIN (SELECT label, (r - 1) // (n // 4 + 1) AS part FROM (SELECT label, row_number() OVER (ORDER BY md5('42|' || label), label) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM labels_))) USING (label)", graph="mid"),
    "khop_membership": sql("SELECT part, node, hop FROM members"),
    "khop_bitmask": sql("SELECT node, bit_or(1::BIGINT << part::INT) AS mask FROM members GROUP BY node"),
    "khop_boundary": sql("SELECT part, node FROM members WHERE hop = 3"),
    "value_propagation": sql("SELECT node, value FROM v3"),
    "value_rank_in_part": sql("SELECT part, node, value, rank FROM ranked"),
    "merge_cost_pairs": sql("SELECT a.part AS a, b.part AS b, a.n + b.n - coalesce(o.n, 0) AS n_union, coalesce(o.n, 0) AS n_both, round(((a.n + b.n - coalesce(o.n, 0)) * ((SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)) + (a.n + b.n - coalesce(o.n, 0)) * 100) * 4 / 1048576, 6) AS cost FROM sizes a JOIN sizes b ON a.part < b.part LEFT JOIN both_ o ON o.i = a.part AND o.j = b.part"),
    "merge_plan_whole": sql("SELECT part, 0::BIGINT AS merged_part, 4::BIGINT AS weight FROM sizes"),
    "merge_plan_refused": sql("SELECT part, part AS merged_part, CASE WHEN part IN (SELECT part FROM cheap UNION ALL SELECT part FROM dear) THEN 3 ELSE 1 END::BIGINT AS weight FROM sizes"),
    "partition_job": sql("SELECT 0::BIGINT AS part, (SELECT count(DISTINCT node) FROM members) AS n_nodes, (SELECT count(*) FROM edges WHERE dst IN (SELECT node FROM members WHERE hop < 3)) + (SELECT count(*) FROM seeds) AS n_edges, 0::BIGINT AS seq"),
    "partition_job_seeds": sql("SELECT 0::BIGINT AS part, node FROM seeds"),
    "value_rank_local": sql("SELECT part, rank, lid FROM ranked JOIN ids USING (part, node)"),
    "epoch_schedule": sql("SELECT epoch * 4 + seq AS step, epoch, part FROM turns, (SELECT unnest(range(3)) AS epoch)"),
    "batch_gather_by_slot": sql("SELECT batch, lid, label AS value FROM mapping JOIN feats USING (node)"),
    "gcn_log_softmax": sql(_ENTRIES.format(keys="node", rows="SELECT node, dim, val - top - ln(sum(exp(val - top)) OVER (PARTITION BY node)) AS val FROM (SELECT *, max(val) OVER (PARTITION BY node) AS top FROM c2)")),
    "sampled_scores": sql(_ENTRIES.format(keys="node", rows="SELECT * FROM evs")),
    "sampled_accuracy": sql("SELECT split, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM evp JOIN feats USING (node) JOIN split_ USING (node) GROUP BY split"),
    "sampled_loss": sql("SELECT count(*) AS n, round(avg(-own), 6) AS loss FROM (SELECT node, max(val) FILTER (WHERE dim = label) - max(top) - ln(sum(exp(val - top))) AS own FROM (SELECT *, max(val) OVER (PARTITION BY node) AS top FROM evs) JOIN feats USING (node) GROUP BY node)"),
    "gat_eight_heads": sql(_ENTRIES.format(keys="node", rows="SELECT node, dim, CASE WHEN val > 0 THEN val ELSE exp(val) - 1 END AS val FROM (SELECT n.node, d.dim, coalesce(a.val, 0) AS val FROM nodes n CROSS JOIN (SELECT unnest(range(32)) AS dim) d LEFT JOIN (" + " UNION ALL ".join(f"SELECT node, dim + {4 * i} AS dim, val FROM gh{i}" for i in range(8)) + ") a ON a.node = n.node AND a.dim = d.dim)")),
    "lp_split_rows": sql("SELECT split, src AS source_node, dst AS target_node, string_agg(('0x' || substr(md5('42|' || src || '|' || dst || '|' || k), 1, 8))::BIGINT % (SELECT count(*) FROM nodes), ',' ORDER BY k) AS target_node_neg FROM (SELECT *, unnest(range(1, CASE WHEN split = 'train' THEN 2 ELSE 6 END)) AS k FROM lp) GROUP BY split, src, dst"),
    "merged_boundary": sql("SELECT part // 2 * 2 AS part, node, min(hop) AS hop, bool_and(hop = 3) AS is_boundary FROM members GROUP BY part // 2 * 2, node"),
    "induced_edges": sql("SELECT part, src, dst FROM kept"),
    "self_loops": sql("SELECT part, node AS src, node AS dst FROM seeds"),
    "closure_violations": sql("SELECT count(*) AS violations FROM edges JOIN interior ON dst = node WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.part = interior.part AND m.node = src)"),
    "local_ids": sql("SELECT part, node, lid FROM ids"),
    "csc_indptr": sql("SELECT part, lid AS dst, coalesce(n, 0) AS deg, (sum(coalesce(n, 0)) OVER (PARTITION BY part ORDER BY lid))::BIGINT AS upto FROM ids LEFT JOIN (SELECT part, dst AS lid, count(*) AS n FROM local_e GROUP BY part, dst) USING (part, lid)"),
    "csc_degrees": sql("SELECT part, lid AS dst, coalesce(n, 0) AS deg FROM ids LEFT JOIN (SELECT part, dst AS lid, count(*) AS n FROM local_e GROUP BY part, dst) USING (part, lid)"),
    "csc_indices": sql("SELECT part, row_number() OVER (PARTITION BY part ORDER BY dst, src) - 1 AS pos, dst, src FROM local_e"),
    "csc_adjacency": sql("SELECT part, dst, count(*) AS deg, string_agg(src::VARCHAR, ',' ORDER BY src) AS nbrs FROM local_e GROUP BY part, dst"),
    "label_gather": sql("SELECT part, lid, node, label FROM ids JOIN feats USING (node)"),
    "seed_local_ids": sql("SELECT part, node, lid FROM seeds JOIN ids USING (part, node)"),
    "partition_manifest": sql("SELECT part, n AS n_nodes, e AS n_edges FROM sizes JOIN (SELECT part, count(*) AS e FROM kept GROUP BY part) USING (part)"),
    "reload_cost_matrix": sql("SELECT i, j, cost FROM costs"),
    "visit_order": sql("SELECT seq, part, path_cost FROM turns"),
    "delta_same": sql("SELECT from_part, to_part, node, prev_pos, next_pos FROM same_"),
    "delta_diff": sql("SELECT from_part, to_part, k, prev_pos, next_pos FROM pairs"),
    "delta_added": sql("SELECT from_part, to_part, node, next_pos FROM added_"),
    "delta_added_features": sql(f"SELECT from_part, to_part, node, {_FEAT} FROM added_ JOIN feats USING (node)"),
    "slot_map_step": sql("SELECT * FROM lap0 UNION ALL SELECT * FROM lap1 UNION ALL SELECT * FROM lap2 UNION ALL SELECT * FROM lap3"),
    "incremental_load": sql("SELECT part, lid, node, label FROM ids JOIN feats USING (node)"),
    "memory_budget": sql("SELECT part, (e + n + 1) * 4 + n * 64 * 4 + n * 8 AS bytes, (e + n + 1) * 4 + n * 64 * 4 + n * 8 > 60000 AS trims FROM sizes JOIN (SELECT part, count(*) AS e FROM kept GROUP BY part) USING (part)"),
    "trim_nodes": sql("SELECT part, node, kept FROM trimmed"),
    "trim_degree": sql("SELECT dst, count(*) AS deg, sum(src)::BIGINT AS src_sum FROM (SELECT src, dst, count(*) OVER (PARTITION BY dst) AS deg, row_number() OVER (PARTITION BY dst ORDER BY md5('42|0|' || dst || '|' || src), src) AS lot FROM alls WHERE dst % 5 <> 0) WHERE deg < 60 OR lot <= floor(deg * 0.5) GROUP BY dst"),
    "tier_init": sql("SELECT part, node, slot FROM slots"),
    "tier_write": sql("SELECT part, slot, CASE WHEN slot % 3 = 0 THEN -node ELSE node END AS value FROM slots"),
    "tier_swap": sql("SELECT s.part, s.node, coalesce(a.ds, b.us, s.slot) AS slot FROM slots s LEFT JOIN swaps a ON a.part = s.part AND a.un = s.node LEFT JOIN swaps b ON b.part = s.part AND b.dn = s.node"),
    "batch_assign": sql("SELECT batch, part, pos, node FROM batches"),
    "sample_hop1": sql("SELECT * FROM s1"),
    "sample_hop2": sql("SELECT * FROM s2"),
    "sample_hop3": sql("SELECT * FROM s3"),
    "sample_fast_tier": sql("SELECT * FROM (SELECT batch, 1::BIGINT AS hop, occ, row_number() OVER (PARTITION BY batch, occ ORDER BY md5('42|' || batch || '|1|' || occ || '|' || src), src) AS k, src, dst FROM f0 JOIN mid ON dst = node WHERE src % 2 = 0) WHERE k <= 3"),
    "full_neighbours": sql("SELECT batch, 1::BIGINT AS hop, occ, row_number() OVER (PARTITION BY batch, occ ORDER BY md5('42|' || batch || '|1|' || occ || '|' || src), src) AS k, src, dst FROM f0 JOIN mid ON dst = node"),
    "batch_remap": sql("SELECT batch, lid, node FROM mapping"),
    "block_edges": sql("SELECT d.batch, l AS depth, hop, occ, k, a.lid AS src_lid, b.lid AS dst_lid FROM (SELECT *, unnest(range(hop, 4)) AS l FROM drawn) d JOIN mapping a ON a.batch = d.batch AND a.node = d.src JOIN mapping b ON b.batch = d.batch AND b.node = d.dst"),
    "batch_features": sql(f"SELECT batch, lid, node, {_FEAT} FROM mapping JOIN feats USING (node)"),
    "range_feature_scan": sql(f"SELECT node, {_FEAT} FROM feats WHERE node >= 2 * ((SELECT count(*) FROM nodes) // 8 + 1) AND node < 3 * ((SELECT count(*) FROM nodes) // 8 + 1)"),
    "sage_mean_layer": sql(_ENTRIES.format(keys="node", rows="SELECT node, i AS dim, sum(v) AS val FROM (SELECT node, i, val * w AS v FROM x0 JOIN ws0 ON dim = j UNION ALL SELECT node, i, val * w FROM nb0 JOIN wn0 ON dim = j) GROUP BY node, i")),
    "gcn_norm_layer": sql(_ENTRIES.format(keys="node", rows="SELECT n.node, w.i AS dim, sum(coalesce(s.val, 0) * w.w) AS val FROM nodes n CROSS JOIN ws0 w LEFT JOIN (SELECT dst AS node, dim, sum(val / sqrt(o.n)) / sqrt(max(g.n)) AS val FROM mid JOIN x0 ON x0.node = src JOIN outdeg o ON o.node = src JOIN indeg g ON g.node = dst GROUP BY dst, dim) s ON s.node = n.node AND s.dim = w.j GROUP BY n.node, w.i")),
    "gat_attention_layer": sql(_ENTRIES.format(keys="node", rows="SELECT n.node, d.dim, (coalesce(a.val, 0) + coalesce(b.val, 0)) * 0.5 AS val FROM nodes n CROSS JOIN (SELECT unnest(range(4)) AS dim) d LEFT JOIN g0 a ON a.node = n.node AND a.dim = d.dim LEFT JOIN g1 b ON b.node = n.node AND b.dim = d.dim")),
    "layerwise_inference": sql(_ENTRIES.format(keys="node", rows="SELECT * FROM scores")),
    "argmax_predict": sql("SELECT node, pred FROM preds"),
    "accuracy_by_split": sql("SELECT split, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds JOIN feats USING (node) JOIN split_ USING (node) GROUP BY split"),
    "gcn_inference": sql(_ENTRIES.format(keys="node", rows="SELECT * FROM c2")),
    "gat_inference": sql(_ENTRIES.format(keys="node", rows="SELECT n.node, d.dim, coalesce(a.val, 0) AS val FROM nodes n CROSS JOIN (SELECT unnest(range(4)) AS dim) d LEFT JOIN g2 a ON a.node = n.node AND a.dim = d.dim")),
    "residual_sage_layer": sql(_ENTRIES.format(keys="node", rows="SELECT node, i AS dim, sum(val * w) + 0.1 AS val FROM r3 JOIN wr3 ON dim = j GROUP BY node, i")),
    "mean_loss": sql("SELECT count(*) AS n, round(avg(-own), 6) AS loss FROM (SELECT node, max(val) FILTER (WHERE dim = label) - max(top) - ln(sum(exp(val - top))) AS own FROM (SELECT *, max(val) OVER (PARTITION BY node) AS top FROM scores) JOIN feats USING (node) GROUP BY node)"),
    "parameter_count": "SELECT (2 * 8 * 64 + 2 * 10 * 8)::BIGINT AS n_params",
    "trim_places": sql("SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS place FROM trimmed WHERE kept"),
    "trim_features": sql(f"SELECT part, place, node, {_FEAT} FROM (SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS place FROM trimmed WHERE kept) JOIN feats USING (node)"),
    "partition_extremes": sql("SELECT (SELECT part FROM sizes ORDER BY n, part LIMIT 1) AS min_part, (SELECT part FROM sizes ORDER BY n DESC, part LIMIT 1) AS max_part, (SELECT max(n) FROM sizes) AS max_n"),
    "seeds_per_part": sql("SELECT part, count(*) AS n, (count(*) - 1) // 16 + 1 AS batches FROM seeds GROUP BY part"),
    "seed_labels_by_size": sql("SELECT label, count(*) AS n FROM labels_ GROUP BY label", graph="mid"),
    "slice_ids": sql("SELECT node // ((SELECT count(*) FROM nodes) // 8 + 1) AS slice, node FROM nodes"),
    "zero_features": sql("SELECT node, unnest(range(4)) AS dim, 0.0::DOUBLE AS val FROM nodes"),
    "synthetic_train_ids": sql("SELECT node FROM (SELECT node, row_number() OVER (ORDER BY md5('42|' || node), node) AS r FROM nodes) WHERE r <= floor((SELECT count(*) FROM nodes) * 0.01)"),
    "lp_split": sql("SELECT split, src, dst FROM lp"),
    "lp_negatives": sql("SELECT split, src, dst, k, ('0x' || substr(md5('42|' || src || '|' || dst || '|' || k), 1, 8))::BIGINT % (SELECT count(*) FROM nodes) AS neg_dst FROM (SELECT *, unnest(range(1, CASE WHEN split = 'train' THEN 2 ELSE 6 END)) AS k FROM lp)"),
    "partition_summary": sql("SELECT part, count(*) AS nodes, count(*) FILTER (WHERE hop < 3) AS interior, count(*) FILTER (WHERE hop = 3) AS boundary, max(e) AS edges_kept FROM members JOIN (SELECT part, count(*) AS e FROM kept GROUP BY part) USING (part) GROUP BY part"),
}
