"""Small graphs for tests."""

import random


def walkers():
    return {
        "video": "v1", "video_path": "v1.mp4", "video_width": 100, "video_height": 100,
        "temporal_nodes": [{"clip_id": 0, "start_frame": 0, "end_frame": 9}],
        "object_nodes": [
            {"node_id": "person_0", "global_track_id": 0, "object_class": "person", "start_frame": 0, "end_frame": 9, "shot_ids": [0], "bboxes": {"0": [0.0, 0.0, 10.0, 20.0], "9": [5.0, 0.0, 15.0, 20.0]}, "attributes": ["in red"], "environment": ["near a wall"]},
            {"node_id": "dog_1", "global_track_id": 1, "object_class": "dog", "start_frame": 2, "end_frame": 7, "shot_ids": [0], "bboxes": {"2": [40.0, 40.0, 60.0, 60.0], "7": [42.0, 40.0, 62.0, 60.0]}},
        ],
        "action_nodes": [{"node_id": "action_group_0", "object_id": "person_0", "actions": [{"action_label": "walk", "frame_idx": 0, "start_frame": 0, "end_frame": 4}, {"action_label": "sit", "frame_idx": 6, "start_frame": 5, "end_frame": 9, "target_object_ids": ["dog_1"]}]}],
        "edges": [{"subject_id": "person_0", "relationships": [{"object_id": "dog_1", "predicate_verb": "left of", "edge_type": "spatial", "time_spans": [{"start_frame": 2, "end_frame": 4}, {"start_frame": 5, "end_frame": 7}]}]}],
    }


def random_graph(seed, n=5):
    r = random.Random(seed)
    names = [f"{r.choice(['person', 'dog', 'car'])}_{i}" for i in range(n)]
    nodes = []
    for i, name in enumerate(names):
        s = r.randint(0, 20)
        e = s + r.randint(3, 30)
        nodes.append({"node_id": name, "global_track_id": i, "object_class": name.split("_")[0], "start_frame": s, "end_frame": e, "shot_ids": [0], "bboxes": {str(f): [float(f), 0.0, f + 10.0, 10.0] for f in range(s, e + 1)}, "attributes": r.sample(["red", "tall", "old", "wet"], r.randint(0, 3)), "environment": r.sample(["near a wall", "in rain"], r.randint(0, 1))})
    acts, edges = [], []
    for name in names:
        items = [{"action_label": r.choice(["walk", "sit", "watch", "run"]), "frame_idx": None, "start_frame": (a := r.randint(0, 40)), "end_frame": a + r.randint(2, 10), "target_object_ids": r.sample(names, r.randint(0, 1))} for _ in range(r.randint(0, 3))]
        if items:
            acts.append({"node_id": f"g_{name}", "object_id": name, "actions": items})
        rels = [{"object_id": r.choice(names), "predicate_verb": r.choice(["left of", "behind", "holding"]), "edge_type": r.choice(["spatial", "contacting"]), "time_spans": [{"start_frame": (a := r.randint(0, 40)), "end_frame": a + r.randint(2, 10)}]} for _ in range(r.randint(0, 3))]
        if rels:
            edges.append({"subject_id": name, "relationships": rels})
    return {"video": f"v{seed}", "video_path": f"v{seed}.mp4", "video_width": 100, "video_height": 100, "temporal_nodes": [{"clip_id": 0, "start_frame": 0, "end_frame": 25}, {"clip_id": 1, "start_frame": 26, "end_frame": 60}], "object_nodes": nodes, "action_nodes": acts, "edges": edges}
