"""Graph operators. Each is a function from DataFrames to a DataFrame.

Relations: edges(src, dst), seeds(node, part), membership(part, node, hop),
local_ids(part, node, lid), features(node, feat), labels(node, label). Ids,
counts and values are BIGINT. Whatever is random is ordered by an MD5 of the
seed and the keys, so that every run gives the same rows.
"""
