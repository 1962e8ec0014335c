"""Schemas of the tables, as DDL; no reader infers one."""

MESSAGE = "id bigint, session_id string, role string, content string, source_docs string, created_at timestamp_ntz"
SESSION = "id string, user_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz"
FEEDBACK = "id bigint, session_id string, message_id bigint, rating string, comment_text string, created_at timestamp_ntz"
CATALOG = "id string, filename string, original_name string, file_type string, file_size bigint, chunk_count bigint, status string, error_msg string, created_at timestamp_ntz"
CHUNK = "id string, content string, doc_id string, doc_name string, file_hash string, pages array<int>, is_table boolean, created_at string"
POINT = "id string, dense array<float>, sparse map<int,float>, content string, doc_id string, doc_name string, file_hash string, pages array<int>, is_table boolean, created_at timestamp"
CACHE = "entry_id bigint, query string, normalized_query string, answer string, source_names array<string>, vector array<float>, created_at double, last_accessed double, hits bigint, canonical string, title string"
ARTICLE = "post_id bigint, slug string, title string, url string, date string, modified string, content string, attachments array<struct<name:string,url:string>>"
MEMORY = "user_id string, key string, value string, updated_at timestamp"
CRAWL_RUN = "run_id string, trigger string, started_at timestamp, finished_at timestamp, new bigint, updated bigint, skipped bigint, failed bigint, errors array<string>"
EVAL_ITEM = "id bigint, question string, ground_truth array<string>, expect_refusal boolean, key_facts array<string>"
ELEMENT = "doc string, pos int, text string, category string, page int"
