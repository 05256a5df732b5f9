"""quillgrove.sources"""
