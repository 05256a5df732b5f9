"""quillgrove.streaming"""
