"""resources"""
