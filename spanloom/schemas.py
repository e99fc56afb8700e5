"""Schemas of timeline tables and documents (times are seconds as DOUBLE)."""

SPAN = "struct<start:double,end:double>"
REGIONS = "v long, ord long, start double, end double, kind string"
TURNS = "v long, ord long, speaker string, start double, end double, text string"
SEGMENT = (
    "struct<segment_start:double,segment_end:double,start:double,end:double,segment_type:string,title:string,description:string,content_label:string,"
    "speakers:array<string>,transcript:string,caption:string,confidence:string,boundary_cues:array<string>>"
)
DOCUMENT = f"video string, saved_at string, labels_attempted boolean, trim_status string, duration double, kept_pct double, boundaries array<double>, segments array<{SEGMENT}>, programs array<struct<program_index:int,program_start:double,program_end:double>>, summary string"
ASR = (
    "results struct<items:array<struct<type:string,start_time:string,end_time:string,alternatives:array<struct<content:string>>>>,"
    "speaker_labels:struct<segments:array<struct<start_time:string,end_time:string,speaker_label:string,items:array<struct<start_time:string>>>>>,"
    "transcripts:array<struct<transcript:string>>>"
)
EVENT = "Records array<struct<eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,size:bigint>>>>"
TRIM_REQUEST = "video_key string, video string, keep_segments array<struct<start:double,end:double>>, output_name string, output_key string"
KINDS = ("black", "white", "freeze", "silence", "bars", "snow")
