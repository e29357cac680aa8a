"""quillstone.sources"""
