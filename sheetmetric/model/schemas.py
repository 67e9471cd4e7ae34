"""Schemas of the input tables and of the interchange document."""

ENTITY = ("sheet_id BIGINT, seq BIGINT, entity_id STRING, dxf_type STRING, layer STRING, block_name STRING, label_text STRING, "
          "points ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, closed BOOLEAN, radius DOUBLE, start_angle DOUBLE, end_angle DOUBLE, height DOUBLE, "
          "attribs MAP<STRING, STRING>")
SHEET = "sheet_id BIGINT, project_id STRING, source_file STRING, insunits INT, measurement INT, discipline STRING"

# one drawing, or one part of a large one, per document: meta data, entities, context
CIO = ("schema_version STRING, "
       "project_meta STRUCT<project_id: STRING, discipline: STRING, drawing_type: STRING, source_file: STRING, dxf_version: STRING, discipline_confidence: DOUBLE>, "
       "parsed_entities ARRAY<STRUCT<entity_id: STRING, category: STRING, sub_category: STRING, layer_role: STRING, "
       "geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>, bbox: ARRAY<DOUBLE>, radius: DOUBLE, closed: BOOLEAN>, "
       "attributes: STRUCT<label_text: STRING, layer_name: STRING, block_name: STRING, dxf_type: STRING, height: DOUBLE, rotation: DOUBLE, raw_attribs: MAP<STRING, STRING>>, "
       "topology: STRUCT<connected_to: ARRAY<STRING>, relation: STRING>>>, "
       "global_context STRUCT<scale_ratio: DOUBLE, units: STRING, layer_summary: MAP<STRING, BIGINT>, all_layers: ARRAY<STRING>, layers_off: ARRAY<STRING>, "
       "layers_frozen: ARRAY<STRING>, block_definitions: ARRAY<STRING>>, "
       "part STRUCT<number: BIGINT, first_seq: BIGINT>")
