"""Explicit schemas of the file formats; nothing is inferred."""

FRAMES = "session_id long, idx long, t long, phase string, score double, present boolean"
MANIFEST = "line long, id string, file string, category string, reference string, frames int, seconds double, source string"
OUTPUT = "id string, category string, reference string, hypothesis string, seconds double"
ANNOTATIONS = "yid string, start string, `end` string, raw_text string, split string"
LANDMARK = "struct<face_landmarks:array<array<array<double>>>,hand_landmarks:array<array<array<double>>>,pose_landmarks:array<array<array<double>>>>"
PROFILE = "session_id long, start_threshold double, stop_threshold double, floor double, separable boolean, phase_peaks map<string,array<double>>"
