"""Schemas of the normalized tables, as DDL."""

CONVERSATION = """
conversation_id string, provider string, source_conversation_id string, title string, summary string,
created_at string, updated_at string, message_count int,
source_artifact struct<root:string,conversation_file:string,sidecar_files:array<string>>,
source_metadata struct<conversation_origin:string,is_archived:boolean,is_starred:boolean,is_read_only:boolean,
is_do_not_remember:boolean,is_study_mode:boolean,default_model_slug:string,account_uuid:string>,
participant_summary struct<roles:array<string>,authors:array<string>>
""".replace("\n", " ").strip()

MESSAGE = """
message_id string, conversation_id string, provider string, source_message_id string, parent_message_id string,
sequence_index int,
content_blocks array<struct<type:string,text:string,start_timestamp:string,stop_timestamp:string,citations:string>>,
source_artifact struct<conversation_file:string,raw_message_path:string>,
source_metadata struct<content_type:string,channel:string,status:string,flags:string>,
author_role string, author_name string, sender string, created_at string, updated_at string, text string,
attachments array<struct<kind:string,path:string,source_ref:string>>
""".replace("\n", " ").strip()

EMBEDDING = """
run_id string, message_id string, conversation_id string, provider string, author_role string, created_at string,
sequence_index int, embedding_model string, embedding_dimensions int, text string, original_text_length int,
stored_text_length int, truncation_occurred boolean, original_token_count int, stored_token_count int,
total_messages_in_run long, build_timestamp string, subset_offset int, subset_limit int, subset_sample_size int,
subset_sample_seed int, embedding array<double>
""".replace("\n", " ").strip()
