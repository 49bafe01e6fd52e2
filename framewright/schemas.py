"""Explicit schemas: nothing is inferred, for map keys that are frame numbers would become columns."""

from __future__ import annotations

SPAN = "struct<start_frame: bigint, end_frame: bigint>"
BOXES = "map<string, array<double>>"
OBJECT = f"struct<node_id: string, global_track_id: bigint, object_class: string, dam_category: string, start_frame: bigint, end_frame: bigint, shot_ids: array<bigint>, bboxes: {BOXES}, attributes: array<string>, environment: array<string>, actions: array<string>>"
ACTION = f"struct<action_label: string, frame_idx: bigint, start_frame: bigint, end_frame: bigint, time_spans: array<{SPAN}>, target_object_ids: array<string>, _source: string>"
ACTIONS = f"struct<node_id: string, object_id: string, actions: array<{ACTION}>>"
RELATION = f"struct<object_id: string, predicate_verb: string, edge_type: string, relationship_type: string, time_spans: array<{SPAN}>, start_frame: bigint, end_frame: bigint>"
EDGE = f"struct<subject_id: string, relationships: array<{RELATION}>, edge_id: string, source_id: string, target_id: string, reference_relationship: string>"
SHOT = "struct<clip_id: bigint, start_time: double, end_time: double, start_frame: bigint, end_frame: bigint, duration: double, num_frames: bigint>"
GRAPH = f"video string, video_path string, video_width bigint, video_height bigint, temporal_nodes array<{SHOT}>, object_nodes array<{OBJECT}>, action_nodes array<{ACTIONS}>, edges array<{EDGE}>"

CLUE = "struct<type: string, text: string, chain_len: int, is_temporal_evidence: boolean>"
TARGET_CLUES = f"struct<target_index: int, object_id: string, class: string, start_frame: bigint, end_frame: bigint, clues: array<{CLUE}>>"
MEMBER = f"struct<object_id: string, start_frame: bigint, end_frame: bigint, target_index: int, boxes: {BOXES}>"
SOLUTION = "struct<status: string, selected_indices: array<int>, objective: int>"
RECORD = f"video_path string, video_width bigint, video_height bigint, query_id string, query string, llm_polished boolean, query_core string, template string, difficulty_bucket string, D_t double, D_s double, D double, target_arity int, target_members array<{MEMBER}>, per_target_queries map<string, string>, clues struct<per_target: array<{TARGET_CLUES}>, shared: array<{CLUE}>>, solver {SOLUTION}"

#: A tube: closed span, boxes by frame, and what it is called.
TRACK = "struct<description: string, s: bigint, e: bigint, boxes: map<bigint, array<double>>>"
MESSAGE = "struct<role: string, content: string>"
