"""What this project's queries know of the wording in its tables; operators get it as parameters."""

from __future__ import annotations

from auditloom.llm.names import Wording

#: Offerings and kinds of organisations with their ways of writing (fixed values).
NAMES = Wording(
    offerings={
        "官网": ["官方网站", "官网", "official website", "official site"],
        "论文库": ["论文库", "论文", "papers"],
        "文档中心": ["文档中心", "文档", "documentation", "docs"],
        "标准库": ["标准库", "标准", "standards"],
        "测试报告库": ["测试报告库", "测评", "benchmarks"],
        "培训课程": ["培训课程", "课程", "training"],
        "代码仓库": ["代码仓库", "代码", "repository", "repo"],
        "数据集平台": ["数据集平台", "数据集", "datasets"],
        "专利检索平台": ["专利检索平台", "专利", "patents"],
        "开发者社区": ["开发者社区", "社区", "forum"],
        "行业资讯": ["行业资讯", "资讯", "news"],
        "参数数据库": ["参数数据库", "参数库", "parameter db", "parameter database"],
        "年度报告": ["年度报告", "年报", "annual report"],
    },
    kinds={
        "科技有限公司": ["科技有限公司", "科技公司", "有限公司", "公司", "科技", "科"], "网络技术": ["网络技术", "网络", "术"], "测控技术": ["测控技术", "测控"], "半导体集团": ["半导体集团", "半导体", "集团", "团"],
        "研究院": ["研究院", "院"], "实验室": ["实验室", "室"], "产业联盟": ["产业联盟", "联盟", "盟"], "标准协会": ["标准协会", "标协", "协会", "协"], "信息中心": ["信息中心", "中心", "心"],
        "开放社区基金会": ["开放社区基金会", "基金会", "会"], "光电": ["光电", "光"], "科技": ["科技", "技"],
        "systems": ["sys"], "technologies": ["tech"], "association": ["assoc", "assn"], "institute": ["inst"], "networks": ["netw", "nets"], "foundation": ["fdn", "found"], "laboratories": ["labs", "lab"],
        "photonics": ["phot"], "instruments": ["instr"],
    },
    default="官网",
    dated=frozenset({"年度报告"}),
)

#: Other words for the entries of source_type_list (fixed values).
SOURCE_TYPES = {
    "技术文档": ["文档", "手册", "指南", "接口说明", "规格书", "产品手册", "开发手册", "用户手册", "用户指南", "安装说明书", "说明书", "API文档", "技术资料文档", "documentation", "tech docs", "user manual", "manual", "user guide", "docs", "jishu wendang"],
    "研究报告": ["报告", "白皮书", "调研", "调研报告", "评测", "评测报告", "测评报告", "市场分析", "行业研报", "研报", "分析报告", "report", "industry report", "research report", "white paper", "market analysis", "yanjiu baogao", "diaoyan baogao"],
    "标准规范": ["标准", "规范", "行业标准", "国家标准", "团体标准", "国标", "团标", "协议规范", "技术规范", "standard", "specification", "specification std", "biaozhun", "biaozhun guifan"],
    "技术社区": ["社区", "论坛", "讨论区", "问答", "问答社区", "开发者社区", "开发者论坛", "BBS", "forum", "community", "jishu shequ"],
    "代码仓库": ["源码", "源代码", "源码库", "代码库", "开源项目", "GIT仓库", "仓库", "repo", "repository", "code repository", "source code", "daima cangku"],
    "官方网站": ["官网", "官方站点", "主页", "公司主页", "门户", "企业门户", "homepage", "official site", "official website", "website", "guanfang wangzhan"],
    "专利文献": ["专利", "专利文件", "发明专利", "专利公开文本", "授权文本", "patent", "patents", "zhuanli", "zhuanli wenxian"],
    "数据集": ["语料", "语料集", "样本集", "基准数据", "开放数据集", "dataset", "data set", "corpus", "shujuji"],
    "学术论文": ["论文", "期刊", "期刊文章", "会议论文", "预印本", "paper", "journal article", "preprint", "xueshu lunwen"],
    "数据库": ["资料库", "参数库", "检索库", "查询数据库", "database", "data base", "shujuku"],
    "新闻资讯": ["新闻", "资讯", "快讯", "媒体报道", "行业新闻", "news", "press release", "xinwen", "xinwen zixun"],
    "课程教程": ["课程", "教程", "公开课", "入门课程", "培训视频", "tutorial", "online course", "course", "kecheng jiaocheng"],
}
