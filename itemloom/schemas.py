"""Schemas of the data model, as DDL (all fields nullable; arrays carry reading order by position)."""

COORDINATES = "struct<x0:double,y0:double,x1:double,y1:double,width:double,height:double>"
SPAN = f"struct<page:int,text:struct<text:string,coordinates:{COORDINATES},block_type:string>>"
IMAGE = "struct<page:int,filename:string,filepath:string,width:int,height:int>"
PAGE_SIZE = "struct<page:int,width:double,height:double>"
RAW_EXTRACTION = (
    "timestamp string, pdf_file string, paper_id string, "
    f"metadata struct<filename:string,paper_id:string,total_pages:int,page_dimensions:array<{PAGE_SIZE}>>, "
    f"text_blocks array<{SPAN}>, images array<{IMAGE}>, extraction_status string"
)
PAGE_ELEMENTS = "source_file string, pages array<struct<page_number:int,elements:array<struct<type:string,text:string,path:string,x0:double,top:double,x1:double,bottom:double>>>>"
SIMPLE_QUESTION = "paper_id string, question_number int, question_text string, options array<string>, page_start int, page_end int"
OPTION = "struct<id:string,text:string,latex:string>"
ANNOTATIONS = "struct<difficulty:string,concepts:array<string>,computable_solution:string>"
QUESTION = (
    "question_id string, exam_name string, exam_date_shift string, subject string, question_number int, question_type string, "
    "question_text string, question_latex string, question_images array<string>, chemical_smiles array<string>, "
    f"options array<{OPTION}>, correct_answer string, ml_annotations {ANNOTATIONS}"
)
COMBINED = QUESTION + ", difficulty string, concepts array<string>, extraction_confidence double, notes string"
MARKDOWN_QUESTION = "question_id string, question_number int, question_latex string, options array<struct<id:string,latex:string,text:string>>, correct_answer string, subject string, question_type string"
RAW_ANSWERS = "source_file string, questions array<struct<question_number:string,correct_answer:string>>"
CLEAN = "paper_id string, year int, date string, shift int, question_number int, question_text string, options array<string>, question_type string, correct_index int, correct_answer int, correct_answer_raw string"
TAGGED = CLEAN + ", subject string, topic string, difficulty string"
ENRICHED = (
    "question_number int, question_prompt string, options array<struct<id:string,text:string>>, "
    "answer_details struct<correct_option_id:string,correct_option_text:string>, "
    "metadata struct<source_file:string,subject:string,topic:string,difficulty:string,type:string>"
)
VECTORS = "vec_id long, embedding array<float>, meta string"
#: Values that are missing in tagged records, with their defaults.
DEFAULTS = {"question_text": "", "question_type": "mcq", "subject": "Unknown", "topic": "Unknown", "difficulty": "medium", "year": 0, "shift": 0, "question_number": 0}
