"""Schemas of the tables that jobs read and write."""

from __future__ import annotations

SIGNAL = (
    "struct<filtered:boolean,filteredBy:array<string>,preserved:boolean,preservedBy:string,"
    "filterDetails:array<string>,velocityBufferSize:bigint,isHistorical:boolean,"
    "isGenuineResponse:boolean,isGenuineUserInput:boolean>"
)
METADATA = (
    "struct<artifacts:array<struct<type:string,content:string,language:string,selector:string>>,"
    "tools:array<string>,streaming:boolean,messageLength:bigint,claudeModel:string,"
    "processingPipeline:string,detectionMethod:string,isSignalNoise:boolean,"
    f"signalProcessingFilter:array<string>,signalProcessing:{SIGNAL}>"
)
# A stored log line; rows of the first log format lack platform and metadata.
STORED_MESSAGE = f"ts timestamp, platform string, role string, content string, urls array<string>, metadata {METADATA}"
# A posted message before defaults are applied.
POSTED_MESSAGE = (
    f"id string, ts timestamp, platform string, convo string, role string, text string, urls array<string>, "
    f"metadata {METADATA}"
)
ELEMENT = (
    "struct<tag:string,id:string,classes:string,textLength:bigint,textPreview:string,dataAttrs:array<string>,"
    "position:struct<x:bigint,y:bigint,width:bigint,height:bigint>>"
)
DIAGNOSTIC = (
    f"type string, timestamp bigint, elementSignature {ELEMENT}, conversationContext string, transmissionType string"
)
ANALYTICS = (
    "timestamp bigint, sessionTime bigint, type string, testPhase string, url string, conversationId string, data string"
)
TEST_REPORT = (
    "timestamp string, success boolean, server_healthy boolean, "
    "log_counts struct<chat:bigint,verbose:bigint,recent:bigint>, "
    "logs struct<chat:array<string>,verbose:array<string>,recent:array<string>>, "
    "test_results array<struct<test:bigint,name:string,passed:boolean,details:string,timestamp:string>>"
)
