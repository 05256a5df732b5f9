"""quillgrove.functions"""
