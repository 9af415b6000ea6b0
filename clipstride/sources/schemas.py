"""Explicit schemas of everything read or written; nothing is inferred."""

WORDS = "array<struct<word:string,start_sec:double,end_sec:double>>"
STORED_WORDS = "array<struct<word:string,startSec:double,endSec:double>>"

SEGMENTS = (
    "job_id long, segment_id long, start_sec double, end_sec double, text string, word_count int, "
    f"words {WORDS}"
)
SILENCE = "job_id long, start_sec double, end_sec double, duration_sec double"
LOUDNESS = "job_id long, time_sec double, rms_db double"
LABELS = "source string, start_sec double, end_sec double, note string"
CANDIDATES_JSON = "start_sec double, startSec double, end_sec double, endSec double, score double"

# A detector's result as delivered; one document holds a recording or a part of one.
RESULT = (
    "executionId long, jobId long, workerId string, processingVersion long, durationSec double, language string, "
    "videoPath string, audioPath string, part long, "
    f"transcriptSegments array<struct<startSec:double,endSec:double,text:string,wordCount:int,words:{STORED_WORDS}>>, "
    "silenceSegments array<struct<startSec:double,endSec:double,durationSec:double>>, "
    "analysisWindows array<struct<startSec:double,endSec:double,speechDensity:double,silenceRatio:double,"
    "emotionHits:long,continuityScore:double,totalScore:double>>, "
    "clipCandidates array<struct<startSec:double,endSec:double,score:double,transcriptExcerpt:string>>"
)
LOG_LINES = "log_id long, line_no long, line string"
JOB_EVENTS = "event_id long, job_id long, ts timestamp, event_type string, message string"
