"""Document types as data: declared fields (S1, S3), summary classes (P8) and fieldsets.

A table holds a type's fields under column names of its own; a field map (field -> column expression) says which.
Fields that the table does not have are left out, as an absent field is in a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_VECTOR, _VECTORS = "array<float>", "map<int, array<float>>"
_CHUNK = "array<struct<chunk_index: int, page_numbers: array<int>, block_labels: array<string>>>"
_PERSON = "struct<email: string, displayName: string>"

# --- fixed values: declared fields, type -> DDL; other types are added with ``declare`` ------------------
DECLARED: dict[str, str] = {
    "file": f"""docId string, app string, entity string, title string, parentId string, url string, chunks array<string>,
        image_chunks array<string>, chunks_pos array<bigint>, image_chunks_pos array<bigint>, chunks_map {_CHUNK}, image_chunks_map {_CHUNK},
        owner string, ownerEmail string, photoLink string, permissions array<string>, mimeType string, createdAt bigint, updatedAt bigint,
        metadata string, fileHash string, chunk_embeddings {_VECTORS}, image_chunk_embeddings {_VECTORS}""",
    "mail": f"""docId string, threadId string, parentThreadId string, mailId string, userMap map<string, string>, subject string,
        chunks array<string>, `timestamp` bigint, app string, entity string, permissions array<string>, `from` string, `to` array<string>,
        cc array<string>, bcc array<string>, mimeType string, attachmentFilenames array<string>,
        attachments array<struct<fileType: string, fileSize: bigint>>, labels array<string>, chunk_embeddings {_VECTORS}""",
    "event": f"""docId string, name string, description string, url string, baseUrl string, status string, location string,
        createdAt bigint, updatedAt bigint, app string, entity string, creator {_PERSON}, organizer {_PERSON}, attendeesNames array<string>,
        attendees array<{_PERSON}>, startTime bigint, endTime bigint, attachmentFilenames array<string>,
        attachments array<struct<fileId: string, title: string, fileUrl: string, mimeType: string>>, recurrence array<string>,
        joiningLink string, permissions array<string>, cancelledInstances array<string>, defaultStartTime boolean, chunk_embeddings {_VECTOR}""",
    "chat_memory": f"""docId string, chatId string, workspaceId string, email string, turnNumber int, userMessage string,
        assistantMessage string, thinking string, text string, topics array<string>, toolsUsed array<string>, permissions array<string>,
        app string, entity string, createdAt bigint, updatedAt bigint, text_embeddings {_VECTOR}""",
    "user_query": "docId string, query_text string, `timestamp` bigint, count bigint, owner string",
}


def declare(doc_type: str, ddl: str) -> None:
    """Declare a document type, or change one; it must have the id ``docId``."""
    if "docId" not in StructType.fromDDL(ddl).fieldNames():
        raise ValueError(f"{doc_type} has no docId")
    DECLARED[doc_type] = ddl


def declared(doc_type: str) -> StructType:
    """The declared fields of a document type."""
    if doc_type not in DECLARED:
        raise ValueError(f"document type {doc_type} is not declared")
    return StructType.fromDDL(DECLARED[doc_type])


# --- fixed values: summary classes, (type, class) -> output name: source field ---------------------------
SUMMARIES: dict[tuple[str, str], dict[str, str]] = {
    ("chat_attachment", "default"): {"title": "title", "filename": "filename", "dimensions": "dimensions", "chunks_summary": "chunks"},
    ("chat_container", "default"): {"domain": "domain"},
    ("chat_message", "default"): {"text": "text", "mentions": "mentions", "attachmentIds": "attachmentIds", "domain": "domain",
                                  "channelName": "channelName", "isPrivate": "isPrivate"},
    ("chat_user", "autocomplete"): {"name": "name", "email": "email", "app": "app", "entity": "entity", "image": "image"},
    ("datasource", "default"): {"docId": "docId", "name": "name", "createdBy": "createdBy", "createdAt": "createdAt"},
    ("datasource_file", "default"): {"chunks_summary": "chunks", "image_chunks_summary": "image_chunks", "chunks_pos_summary": "chunks_pos",
                                     "image_chunks_pos_summary": "image_chunks_pos", "dataSourceName": "dataSourceName",
                                     "createdBy": "createdBy", "dataSourceId": "dataSourceId"},
    ("datasource_file", "autocomplete"): {"fileName": "fileName", "app": "app", "docId": "docId"},
    ("event", "default"): {"description": "description"},
    ("event", "autocomplete"): {"name": "name", "app": "app", "entity": "entity", "docId": "docId"},
    ("file", "default"): {"chunks_summary": "chunks", "image_chunks_summary": "image_chunks", "chunks_pos_summary": "chunks_pos",
                          "image_chunks_pos_summary": "image_chunks_pos"},
    ("file", "autocomplete"): {"title": "title", "app": "app", "entity": "entity", "docId": "docId"},
    ("kb_items", "default"): {"chunks_summary": "chunks", "image_chunks_summary": "image_chunks", "toc_chunks_summary": "toc_chunks",
                              "chunks_pos_summary": "chunks_pos", "image_chunks_pos_summary": "image_chunks_pos",
                              "chunks_map": "chunks_map", "image_chunks_map": "image_chunks_map"},
    ("kb_items", "autocomplete"): {"fileName": "fileName", "docId": "docId"},
    ("mail", "default"): {"subject": "subject", "chunks_summary": "chunks", "to": "to", "cc": "cc", "bcc": "bcc", "attachments": "attachments"},
    ("mail", "autocomplete"): {"docId": "docId", "threadId": "threadId", "subject": "subject", "app": "app", "entity": "entity"},
    ("mail_attachment", "default"): {"filename": "filename", "chunks_summary": "chunks"},
    ("mail_attachment", "autocomplete"): {"docId": "docId", "filename": "filename", "fileType": "fileType", "app": "app", "entity": "entity"},
    ("ticket", "default"): {"description": "description", "threadSummary": "threadSummary", "commentSummary": "commentSummary",
                            "wholeResolutionSummary": "wholeResolutionSummary"},
    ("user", "autocomplete"): {"name": "name", "email": "email", "app": "app", "entity": "entity", "photoLink": "photoLink"},
    ("user_query", "autocomplete"): {"query_text": "query_text", "docId": "docId"},
}

# --- fixed values: fieldsets, (type, set) -> fields -------------------------------------------------------
FIELDSETS: dict[tuple[str, str], list[str]] = {
    ("chat_attachment", "default"): ["title", "filename", "chunks", "teamId", "messageId"],
    ("chat_container", "default"): ["name", "topic", "description"],
    ("chat_memory", "default"): ["text"],
    ("chat_message", "default"): ["text", "mentions", "teamId", "channelId", "userId", "threadId", "app", "entity", "attachmentIds",
                                  "domain", "channelName", "isPrivate"],
    ("chat_user", "default"): ["name", "email", "title", "statusText"],
    ("chat_user", "autocomplete"): ["name", "email", "app", "entity", "image"],
    ("datasource", "default"): ["name", "createdBy"],
    ("datasource_file", "default"): ["description", "chunks", "uploadedBy", "fileName"],
    ("datasource_file", "autocomplete"): ["fileName", "uploadedBy"],
    ("datasource_file", "search"): ["description", "chunks", "fileName", "uploadedBy"],
    ("episodic_memory", "default"): ["memoryText"],
    ("event", "default"): ["name", "description", "attachmentFilenames", "attendeesNames", "app", "url", "baseUrl", "attendees"],
    ("file", "default"): ["title", "app", "entity", "chunks"],
    ("file", "autocomplete"): ["title", "app", "entity"],
    ("kb_items", "default"): ["description", "toc_chunks", "chunks", "image_chunks", "fileName", "entity", "createdBy", "clFd"],
    ("kb_items", "autocomplete"): ["fileName"],
    ("kb_items", "search"): ["description", "toc_chunks", "chunks", "image_chunks", "fileName", "entity", "clFd"],
    ("mail", "default"): ["subject", "app", "entity", "chunks", "attachmentFilenames", "from", "to", "cc", "bcc", "labels"],
    ("mail", "autocomplete"): ["subject", "app", "entity"],
    ("mail_attachment", "default"): ["filename", "chunks"],
    ("mail_attachment", "autocomplete"): ["filename"],
    ("ticket", "default"): ["subject", "description", "threadSummary", "commentSummary", "wholeResolutionSummary"],
    ("ticket", "autocomplete"): ["subject"],
    ("user", "autocomplete"): ["name", "email", "app", "entity", "photoLink"],
    ("user", "default"): ["name", "email", "app", "entity", "photoLink", "creationTime"],
    ("user_query", "default"): ["query_text"],
}


def summary(df: DataFrame, doc_type: str, name: str, field_map: dict[str, str]) -> DataFrame:
    """The fields of a summary class; Catalyst prunes the other columns at the scan."""
    return df.select(*[F.expr(field_map[source]).alias(out) for out, source in SUMMARIES[doc_type, name].items() if source in field_map])


def match_fieldset(queries: DataFrame, docs: DataFrame, key: str, doc_type: str, name: str, field_map: dict[str, str]) -> DataFrame:
    """(query_id, key) of documents that hold any query token in a field of the set."""
    from sagebrush.functions.text import tokens
    from sagebrush.operators.textindex import match_any

    fields = [f for f in FIELDSETS[doc_type, name] if f in field_map]
    return match_any(queries, docs, key, {f: tokens(field_map[f]) for f in fields})
