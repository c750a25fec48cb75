"""Fixed schemas of the engine's tables."""

CHUNKS = "id string, file_path string, content string, start_line int, end_line int, embedding array<float>, metadata map<string,string>, is_test boolean"
#: What a store keeps of a chunk: its vector as floats, or quantised (int8, or words of bits) by the store's mode.
STORED_CHUNKS = f"{CHUNKS}, embedding_i8 array<tinyint>, embedding_bits array<bigint>"
FILE_EMBEDDINGS = "file_path string, embedding array<float>, chunk_count long, total_lines int"
SEGMENTS = "chunk_id string, segment_idx int, text string, emb_i8 array<tinyint>, scale float, min float"
POSTINGS = "id string, file_path string, dl long, term string, tf long, places array<int>"
LENGTHS = "id string, file_path string, dl long"
GONE = "kind string, key string"
DATASET = "name string, description string, corpus string, corpus_hash string, queries array<struct<query:string,category:string,judgments:array<struct<file:string,rel:int>>,grep_patterns:array<string>>>"
