"""Schemas of the tables that operators exchange."""

FILE = "path string, size long, mtime timestamp, sha256 string"
MANIFEST = "path string, size long, mtime string, sha256 string"
SECTION = "source_file string, section_ord int, heading string, section_path array<string>, content string, error string, detail string"
CONTEXT = "source_file string, heading string, section_path array<string>, chunk_index int, token_count int, retired boolean"
ENTRY = (
    "id long, content string, content_type string, content_hash string, confidence double, tags array<string>, status string, "
    "access_count long, embedding array<float>, source_agent string, knowledge_domain string, "
    f"context struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in CONTEXT.split(', '))}>, created_at timestamp, updated_at timestamp"
)
FEEDBACK = "question_hash string, chunk_ids array<long>, retrieval_score double, synthesized boolean, rating int"
EXTENSIONS = (".md", ".txt", ".docx", ".pdf")
CHUNK_TAG = "document_chunk"
