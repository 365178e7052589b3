"""Schemas of the tables that operators exchange (D1-D20), as DDL text: readers and createDataFrame take it as it is."""

from __future__ import annotations

NODES = "node_id BIGINT, feat ARRAY<FLOAT>, label BIGINT, split STRING"
EDGES = "src BIGINT, dst BIGINT, eid BIGINT, etype BIGINT"
REMOVED = "src BIGINT, dst BIGINT, eid BIGINT, etype BIGINT, reason STRING"
NODE_WEIGHTS = "node_type BIGINT, w_in_degree BIGINT, w_train BIGINT, w_one BIGINT, node_id BIGINT"
STATS = "num_nodes BIGINT, num_edges BIGINT, num_node_weights BIGINT"
NODE_MAP = "part INT, node_id BIGINT, orig_id BIGINT"
PARTS = "part BIGINT, begin BIGINT, end BIGINT"
TIMINGS = "rank INT, module STRING, epoch INT, seq INT, ms DOUBLE"
LOG = "path STRING, world_size INT, variant STRING, line_no BIGINT, line STRING"
WEIGHTS = "layer STRING, name STRING, i INT, j INT, w DOUBLE"
