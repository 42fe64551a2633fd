"""Schemas of the tables that are read or written."""

CASES = "array<struct<case_index:int,id:string,test_case:string>>"
BLOCK = f"corpus_id string, file_id string, block_index int, id string, title string, material string, language string, training_text string, test_cases {CASES}"
DEV_CASE = "x string, y string, gap_length int, corpus_id string, file_id string"
PREDICTION = "sentence string, token_str string, score double"
MODEL = "id string, TYPE string, LM_SCORE string, GAMMA double, N int, CORPUS_NAMES array<string>, GLOBAL_MODEL_FILE_ID string, DOMAIN_MODEL_FILE_ID string, CHECKPOINT string"
EVALUATION = "ID string, `papiro herc` string, `testo con supplemento` string, testo string, `contesto ampio` string, luogo string"
ERROR = "time timestamp, name string, level string, message string, pathname string"
