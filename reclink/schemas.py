"""Table schemas of the data model, as DDL."""

from __future__ import annotations

RAW = "_id string not null, sourceId string not null, recordId string, clusterId string, bibtype string, sgml string not null"
MENTION = "mention_id string, is_record boolean, source string, true_cluster string, bibtype string, sgml string, words array<string>, labels array<string>, rndkey int"
FIELD_VALUE = "field string, value_id string, record_id string, phrase array<string>, hash_keys array<string>, is_observed boolean"
PARAMS = "model string, kind string, label string, key string, value double"
SEGMENT = "begin int, end int, label string"
COREF_SEGMENT = "begin int, end int, label string, record_id string, value_id string"
