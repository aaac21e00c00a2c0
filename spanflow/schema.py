"""Declared schemas of the library's tables. Intervals are half-open, [start, end), in ticks at a rate."""

SEGMENTS = "rec_id string, start double, end double, rate double, seg_idx int, label string, speaker string, content string, confidence double, source string"
FRAMES = "rec_id string, frame_idx bigint, t double, feat array<double>, active array<int>, class int, chunk_id int, group_id string, split string"
POSTERIORS = "rec_id string, frame_idx bigint, predictor int, probs array<double>"
RECORDINGS = "rec_id string, group_id string, topic_id string, signal_grade double, conv_grade double, speakers array<struct<pin:string,gender:string,dialect:string>>"
AUDIO_CATALOG = "rec_id string, path string, format string, rate int, channels int, seconds double, samples bigint"
