"""Table and nested types as DDL text (usable without a running session)."""

from __future__ import annotations

PERSON = "struct<id:string,fullName:string,role:string,category:string,mentions:array<string>,letter:string>"
OTHER = "struct<id:string,type:string,label:string,value:string,replacement:string,mentions:array<string>>"
AMBIGUOUS = "struct<value:string,context:string,reason:string>"
PERSONAL_DATA = f"struct<persons:array<{PERSON}>,otherPD:array<{OTHER}>,ambiguousPersons:array<{AMBIGUOUS}>>"
SOURCE_FILE = "struct<name:string,size:double,type:string,bucket:string,storagePath:string,uploadedAt:string>"
PAGE = (
    "struct<pageNumber:bigint,chunkPageIndex:bigint,pdfWidth:double,pdfHeight:double,"
    "renderWidth:double,renderHeight:double,rotation:double,mediaType:string>"
)
SOURCE = (
    f"struct<sourceFile:{SOURCE_FILE},batchFileName:string,projectId:string,pageFrom:bigint,pageTo:bigint,"
    f"totalPages:bigint,pages:array<{PAGE}>>"
)
PAGE_METADATA = f"struct<version:int,sources:array<{SOURCE}>>"

# The portable one-document file.
PORTABLE = (
    "version int, exportedAt string, id string, title string, originalFileName string, text string, "
    f"editedHtml string, personalData {PERSONAL_DATA}, anonymized map<string,boolean>, source string, "
    "pageFrom bigint, pageTo bigint, totalPages bigint, chunkIndex bigint, chunkSize bigint, "
    f"batchFileName string, pageMetadata {PAGE_METADATA}, savedAt string"
)

DOCUMENT_ROW = (
    "id string, user_id string, project_id string, title string, original_file_name string, text string, "
    f"edited_html string, personal_data {PERSONAL_DATA}, anonymized map<string,boolean>, source string, "
    "is_project_summary boolean, page_from bigint, page_to bigint, total_pages bigint, chunk_index bigint, "
    f"chunk_size bigint, batch_file_name string, source_files array<{SOURCE_FILE}>, page_metadata {PAGE_METADATA}, "
    "saved_at timestamp, created_at timestamp, updated_at timestamp"
)
PROJECT_ROW = (
    "id string, user_id string, title string, document_ids array<string>, "
    f"shared_pd {PERSONAL_DATA}, batch_session string, created_at timestamp, updated_at timestamp"
)
