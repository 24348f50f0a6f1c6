"""Schemas of the engine's own data sets, as DDL so that importing needs no session."""

PAPER = (
    "paper_id string, title string, authors array<string>, abstract string, categories array<string>, published date, "
    "citation_count int, download_count int, pdf_path string, latex_path string, parse_status string, parse_method string, "
    "created_at timestamp, updated_at timestamp"
)
CHUNK = (
    "chunk_id string, paper_id string, content string, section_title string, chunk_type string, chunk_index int, "
    "token_count int, metadata map<string,string>"
)
CHUNK_VECTORS = (
    "chunk_id string, dense array<float>, dense_second array<float>, sparse map<int,float>, "
    "token_embeddings array<array<float>>"
)
PARSED = (
    "paper_id string, title string, abstract string, parse_method string, source_file string, "
    "sections array<struct<section_id:string,title:string,level:int,order:int,"
    "paragraphs:array<struct<paragraph_id:string,content:string,order:int>>>>, "
    "equations array<struct<equation_id:string,latex:string,label:string,is_inline:boolean,text_description:string,"
    "context_before:string,context_after:string>>, "
    "figures array<struct<figure_id:string,caption:string,label:string,image_path:string>>, "
    "tables array<struct<table_id:string,caption:string,content:string,row_count:int>>"
)
EVAL_QUERY = (
    "query string, relevant_papers array<string>, relevant_chunks array<string>, category string, original_relevant_count int"
)
