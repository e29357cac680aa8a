"""quillstone.functions"""
