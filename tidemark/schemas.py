"""Column types of the tables the jobs read and write."""

QUESTIONS = "question_id string, videoID string, video_id string, duration string, domain string, sub_category string, task_type string, question string, options array<string>, answer string, url string"
SELECTION = "video_id string, videoID string, duration string, domain string, sub_category string, url string"
MANIFEST = "video_id string, video_path string, subtitle_path string, asset_id string, domain string, sub_category string"
CUES = "video_id string, cue_idx long, start double, end double, text string"
FRAME_EMB = "video_id string, frame_idx long, t double, emb array<float>"
TEXT_EMB = "video_id string, t double, text string, emb array<float>"
EVENTS = "video_id string, modality string, timestamp_seconds double, visual_score double, text_score double, nearest_other_peak_seconds double, event_type string, subtitle_text string"
LEXICON = "word string, category string"
